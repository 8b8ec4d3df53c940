"""Token ids in Re-Pair compressed shards, written in id order and read back at random.

A shard is one binary value (see `pack_shard`): frequent neighbouring ids are replaced by
nonterminals, round after round, and the shard keeps its rules and how many ids each rule
stands for, so a document, or a range of its ids, decodes without the rest. Shards travel
in Parquet rows, which any Hadoop store can hold and Spark reads and writes natively.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import Encoder
from .shared import give_back, small_batches, staged, text_bytes

MAGIC = b"RPS1"
HEADER = "<4sHIIIQ"  # magic, bytes per symbol, documents, rules, symbols, ids
#: Ids per shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Uses that pay for a rule's 12 bytes, and how far below the most frequent pair a round goes.
LEAST, FALL = 8, 16
#: Slots that pairs hash to.
SLOTS = 19

STORED = "part int, shard int, offset long, n_docs int, n_ids long, first_id long, last_id long, body binary"
READ = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"


def _counted(code):
    """Sorted distinct numbers and how often each occurs."""
    import numpy as np

    told = np.sort(code)
    start = np.flatnonzero(np.r_[True, told[1:] != told[:-1]]) if len(told) else np.zeros(0, np.int64)
    return told[start], np.diff(np.r_[start, len(told)])


def re_pair(ids, last):
    """Replace frequent pairs in `ids` (unsigned 32-bit); `last` marks each document's last id.

    Returns symbols, their `last` marks, rules (left, right) and the first nonterminal.
    No rule spans two documents. In `aaa` the left pair is taken. A round takes the pairs that are at least 1 / FALL
    times as frequent as the most frequent one; rounds go on until no pair pays for its rule. While symbols fit 16
    bits they take 2 bytes: beyond, pairs pay only if they save what wider symbols cost.
    """
    import numpy as np

    base, made = int(ids.max()) + 1 if len(ids) else 1, 0
    seq, rules, floor, widened, fresh = ids.astype(np.uint32), [], None, False, None
    while len(seq) > 1:
        narrow = base + made < 1 << 16
        # A pair is one number; where symbols fit 16 bits it is a short one, which sorts twice as fast.
        word, half, factor = (np.uint32, 16, 0x9E3779B1) if narrow else (np.uint64, 32, 0x9E3779B97F4A7C15)
        down = word(2 * half - SLOTS)
        # Once all pairs were looked at, only those of newer symbols can have become frequent.
        place = np.flatnonzero(~last[:-1] if fresh is None else ~last[:-1] & ((seq[:-1] >= fresh) | (seq[1:] >= fresh)))
        code = (seq[place].astype(word) << word(half)) | seq[place + 1].astype(word)
        slot = ((code * word(factor)) >> down).astype(np.int32)
        met = np.bincount(slot, minlength=1 << SLOTS)
        # A slot has at least as many pairs as each pair in it has.
        most = max(LEAST, -(-int(met.max()) // FALL)) if floor is None else floor
        hot = np.flatnonzero((met >= most)[slot])
        place, code, slot = place[hot], code[hot], slot[hot]
        pairs, n = _counted(code)
        pairs, n = pairs[n >= most], n[n >= most]
        room = (1 << 16) - base - made
        if narrow and len(pairs) > room:
            top = np.sort(np.argsort(-n, kind="stable")[:room])
            pairs, n = pairs[top], n[top]
        if room == 0 and not widened:
            if most > LEAST:
                floor = LEAST  # all pairs that would pay are looked at
                continue
            if 4 * (len(seq) - int(n.sum())) + 12 * len(pairs) >= 2 * len(seq):
                break
            widened = True
        at = place[:0]
        if len(pairs):
            table = np.full(1 << SLOTS, -1, np.int32)
            table[(pairs * word(factor)) >> down] = np.arange(len(pairs), dtype=np.int32)  # of two in a slot one waits for the next round
            rule = table[slot]
            hit = np.flatnonzero((rule >= 0) & (pairs[rule] == code))
            at, rule = place[hit], rule[hit]
            if len(at):  # of neighbouring hits every second one, from the left
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
                other = (np.arange(len(at)) - run) % 2 == 0
                at, rule = at[other], rule[other]
            pays = np.bincount(rule, minlength=len(pairs)) >= LEAST
            at, rule = at[pays[rule]], rule[pays[rule]]
        if not len(at):
            if most == LEAST and fresh is None:
                break
            floor, fresh = max(LEAST, most // FALL), None  # a slot of many pairs hid that none is so frequent; at last all are counted again
            continue
        floor, fresh = None, base + made if most == LEAST else None
        number = np.cumsum(pays) - 1 + base + made
        last = last.copy()
        seq[at] = number[rule]
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        pairs = pairs[pays]
        rules.append(np.stack([pairs >> word(half), pairs & word((1 << half) - 1)], 1).astype(np.uint32))
        made += len(pairs)
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), base


def expansion_lengths(rules, base: int):
    """How many ids each rule stands for; a rule only names earlier symbols."""
    import numpy as np

    size = np.ones(base + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        size[base + k] = size[a] + size[b]
    return size[base:]


def pack_shard(doc_ids: list, encoded: list[bytes]) -> bytes:
    """Header; ids (0 for null) and null marks; symbols and ids per document; rules, lengths, symbols."""
    import numpy as np

    counts = np.array([len(e) // 4 for e in encoded], np.uint32)
    ids = np.frombuffer(b"".join(encoded), "<u4")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts[counts > 0], dtype=np.int64) - 1] = True
    seq, ends, rules, base = re_pair(ids, last)
    held = np.zeros(len(counts), np.uint32)
    held[counts > 0] = np.diff(np.flatnonzero(ends), prepend=-1)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return b"".join([
        struct.pack(HEADER, MAGIC, width, len(doc_ids), len(rules), len(seq), len(ids)),
        struct.pack("<I", base),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        held.astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(),
        seq.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """A shard's parts, as views of its bytes."""

    def __init__(self, body: bytes):
        import numpy as np

        magic, width, docs, rules, symbols, self.n_ids = struct.unpack_from(HEADER, body)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(HEADER)
        (self.base,) = struct.unpack_from("<I", body, at)
        at += 4

        def take(kind: str, n: int):
            nonlocal at
            found = np.frombuffer(body, kind, n, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.held, self.counts = take("<u4", docs), take("<u4", docs)
        self.rules, self.sizes = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)

    def expand(self, symbols):
        """Ids that symbols stand for: all nonterminals at once, until none is left."""
        import numpy as np

        seq = symbols.astype(np.uint32)
        while len(at := np.flatnonzero(seq >= self.base)):
            rule = self.rules[seq[at] - self.base]
            longer = np.ones(len(seq), np.int64)
            longer[at] = 2
            place = at + np.arange(len(at))
            seq = np.repeat(seq, longer)
            seq[place], seq[place + 1] = rule[:, 0], rule[:, 1]
        return seq

    def document(self, k: int, start: int = 0, stop: int | None = None):
        """Ids `start:stop` of the shard's k-th document; only symbols that reach into them expand."""
        import numpy as np

        first = int(self.held[:k].sum())
        own = self.symbols[first : first + int(self.held[k])]
        stop = int(self.counts[k]) if stop is None else min(stop, int(self.counts[k]))
        size = np.ones(len(own), np.int64)
        size[own >= self.base] = self.sizes[own[own >= self.base].astype(np.int64) - self.base]
        ends = np.cumsum(size)
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = int(ends[lo] - size[lo]) if lo < len(ends) else 0
        return self.expand(own[lo:hi])[max(0, start - skip) : max(0, stop - skip)]


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and store them in ascending id order; returns the stored shards, one a row.

    Ranges of ids are tasks, and a task cuts its range into shards of about `shard_ids` ids.
    Null ids come first, equal ids in any order, null and empty texts are the end id alone,
    an empty table makes no shard. `offset` counts the task's ids before a shard.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        give_back()
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held: list = []
        ids: list = []
        size = shard = offset = 0

        def close():
            known = [i for i in ids if i is not None]
            row = (part, shard, offset, len(ids), size, known[0] if known else None, known[-1] if known else None, pack_shard(ids, held))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "shard", "offset", "n_docs", "n_ids", "first_id", "last_id", "body"])

        for batch in batches:
            for doc, e in zip(batch.column(0).to_pylist(), encoder.encode(text_bytes(batch.column(1)))):
                e += end
                if ids and size + len(e) // 4 > shard_ids:
                    yield close()
                    shard, offset = shard + 1, offset + size
                    held, ids, size = [], [], 0
                ids.append(doc)
                held.append(e)
                size += len(e) // 4
        if ids:
            yield close()

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, STORED), "token-shards")


def read_store(store: DataFrame) -> DataFrame:
    """Decode every shard. Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts add three sums: within the shard, of the shard within its task, of earlier tasks;
    the last has one row a task.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, offset, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard = Shard(body)
                ids = shard.expand(shard.symbols).astype("<u4").tobytes()
                ends = np.cumsum(shard.counts, dtype=np.int64)
                starts = ends - shard.counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array([part] * len(crc), pa.int32()), pa.array(starts + offset), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = store.select("part", "offset", "body").mapInArrow(run, READ)
    return found.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
