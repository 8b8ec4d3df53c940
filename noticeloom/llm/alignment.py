"""Token ids of two tokenizers aligned by bytes, and counts of the pairs that end together.

Both tokenizers read a text as one string with a blank in front. Where an id of A and an id of B end at
the same byte, the text is cut into groups, and the two ids are a pair.

The counts are a cogroup of postings. Every block of documents sends, for each range of side ids (ids
of B), the pairs with the documents that hold them and how often. Counts of pairs, added up
before, and postings stream sorted by range into the same tasks, which know the highest count of
each side id and send every document's share back to its block; blocks sum them up.
"""

from __future__ import annotations

import hashlib
import json
import os

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, small_batches, staged

#: Ranges of side ids; their number does not grow with the corpus.
SIDES = 64
#: Documents and letters after which a block ends, and letters that are aligned in one go.
BLOCK_DOCS, BLOCK_LETTERS, PORTION = 1024, 4_000_000, 500_000
#: Bytes of postings that one stream of a range takes; a range with more is split by blocks.
STREAM_BYTES = 64_000_000
#: Pairs that a task adds up before it packs them.
PAIRS = 2_000_000
#: How the piece model writes a blank.
BLANK_PIECE = "\u2581"

BLOCKS = "block long, side int, body binary, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, shares binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, groups string"

_kept: dict = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others moved up from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(moved)}


class Spelling:
    """The bytes of every id, and how ids are written in groups."""

    def __init__(self, table: list[bytes], marks: str):
        """`marks`: what stands after an id inside a group, and after its last."""
        import numpy as np

        self.table, n = table, len(table)
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        told = np.char.encode(np.char.add(np.arange(n).astype("U10")[None], np.array(list(marks))[:, None])).reshape(-1)
        #: Rows of letters: the ids with the first mark, then the ids with the second.
        self.told = told.view(np.uint8).reshape(2 * n, -1)

    def spelt(self, ids):
        """The bytes of ids, joined."""
        import numpy as np

        size = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]


class ByteSide(Spelling):
    """A byte-level BPE from a tokenizers file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        table = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            table[number] = bytes(map(letters.__getitem__, token))
        super().__init__(table, ",|")
        # Ids in the order of merges are ranks, which a faster encoder takes; else the file's own tokenizer works.
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(vocab) - len(merges)
        self.ranked = all(vocab[a + b] == first + k for k, (a, b) in enumerate(merges))
        if self.ranked:
            self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: k for k, b in enumerate(table)}, special_tokens={})
            probes = [" Hello  world's\n\n x1!! \r\n \u00e9 ", " <|endoftext|> \u3000\u65e5\u672c 12 a-b", "  \x1c!\x1c a\xa0 b"]
            self.ranked = all(self.encoding.encode_ordinary(p) == self.whole(p) for p in probes)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str):
        """Ids of a text with a blank in front."""
        return self.encoding.encode_to_numpy(f" {text}") if self.ranked else self.whole(f" {text}")


class PieceSide(Spelling):
    """A sentencepiece BPE with byte fallback; it puts a blank in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = lambda k, p: bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(BLANK_PIECE, " ").encode()
        super().__init__([piece(k, model.id_to_piece(k)) for k in range(model.get_piece_size())], ",;")

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Pair:
    """Both sides."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteSide(byte_path), PieceSide(piece_path)
        if len(self.a.table) > 1 << 19 or len(self.b.table) > 1 << 16:
            raise ValueError("pairs hold ids of A below 2^19 and of B below 2^16")

    @classmethod
    def of(cls, byte_path: str, piece_path: str) -> Pair:
        """One per worker process and pair of files."""
        if (byte_path, piece_path) not in _kept:
            _kept[byte_path, piece_path] = cls(byte_path, piece_path)
        return _kept[byte_path, piece_path]

    def align(self, texts: list[str | None]):
        """Per text: ids of A, ids of B, groups, groups as bytes; per link: the text's place, id of A, id of B."""
        import numpy as np

        sizes, told = np.zeros((3, len(texts)), np.int64), [b""] * len(texts)
        alike, ids = [], [[], []]
        for k, text in enumerate(texts):
            if not text:
                continue
            own = [np.asarray(side.encode(text), np.int64) for side in (self.a, self.b)]
            raw = np.frombuffer(f" {text}".encode(), np.uint8)
            if all(np.array_equal(side.spelt(x), raw) for side, x in zip((self.a, self.b), own)):
                alike.append(k)
                for into, x in zip(ids, own):
                    into.append(x)
        if not alike:
            return sizes, told, np.zeros((3, 0), np.int64)
        for n, x in zip(sizes, ids):
            n[alike] = list(map(len, x))
        a, b = map(np.concatenate, ids)
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])  # on both sides a text ends at the same byte
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        cut_a = np.flatnonzero(ends_b[at] == ends_a)
        cut_b = at[cut_a]
        # The places that ids of both sides have when groups are written one after the other.
        in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)
        width = max(self.a.told.shape[1], self.b.told.shape[1])
        letters = np.zeros((len(a) + len(b), width), np.uint8)
        for side, x, place, cut in ((self.a, a, place_a, cut_a), (self.b, b, place_b, cut_b)):
            row = x.copy()
            row[cut] += len(side.table)
            letters[place, : side.told.shape[1]] = side.told[row]
        used = letters > 0
        written = letters[used].tobytes()
        last_b = np.cumsum(sizes[1, alike]) - 1
        ends = np.cumsum(used.sum(1))[place_b[last_b]].tolist()
        for k, x, y in zip(alike, [0, *ends], ends):
            told[k] = written[x : y - 1]
        text = np.searchsorted(last_b, cut_b)
        sizes[2, alike] = np.bincount(text, minlength=len(alike))
        return sizes, told, np.array([np.array(alike)[text], a[cut_a], b[cut_b]])


def _planes(numbers, width: int) -> bytes:
    """Numbers byte by byte: high bytes are mostly zeros, which compress."""
    import numpy as np

    return np.ascontiguousarray(numbers, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(planes: bytes, width: int):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def pack_postings(keys, per_key, docs, n) -> bytes:
    """A block's postings in one range: pairs, how many documents hold each, the documents' places in the block, multiplicities."""
    import numpy as np

    return b"".join([np.array([len(keys), len(docs)], "<u4").tobytes(), _planes(np.diff(keys, prepend=0), 8), _planes(per_key, 4), _planes(docs, 2), _planes(n, 4)])


def unpack_postings(body: bytes):
    import numpy as np

    k, m = np.frombuffer(body, "<u4", 2).tolist()
    cut = np.cumsum([8, 8 * k, 4 * k, 2 * m, 4 * m]).tolist()
    parts = [_numbers(body[x:y], w) for x, y, w in zip(cut, cut[1:], (8, 4, 2, 4))]
    return np.cumsum(parts[0]), *parts[1:]


def side_of(b):
    """The range that an id of B belongs to: mixed, as frequent ids lie together."""
    return (b * 40503 >> 3) % SIDES


def block_rows(block: int, docs: list, pair: Pair, texts: list[str | None]):
    """Rows of a block: one with its documents, one with postings for each range."""
    import numpy as np
    import pyarrow as pa

    sizes, digests, links = [], [], []
    first = 0
    while first < len(texts):
        end, letters = first + 1, len(texts[first] or "")
        while end < len(texts) and (letters := letters + len(texts[end] or "")) <= PORTION:
            end += 1
        own, told, found = pair.align(texts[first:end])
        sizes.append(own)
        digests += [hashlib.sha256(x).hexdigest() if x else "" for x in told]
        links.append(side_of(found[2]) << 51 | found[2] << 35 | found[1] << 16 | found[0] + first)
        first = end
    side, body = [], []
    found, n = np.unique(np.concatenate(links), return_counts=True)
    cut = np.searchsorted(found >> 51, np.arange(SIDES + 1))
    for s in range(SIDES):
        if cut[s] < cut[s + 1]:
            own = found[cut[s] : cut[s + 1]] & (1 << 51) - 1
            new = np.flatnonzero(np.r_[True, np.diff(own >> 16) != 0])
            side.append(s)
            body.append(pack_postings(own[new] >> 16, np.diff(np.r_[new, len(own)]), own & 0xFFFF, n[cut[s] : cut[s + 1]]))
    m = len(side)
    listed = lambda x, kind: pa.array([x, *[None] * m], pa.list_(kind))
    columns = [
        pa.array([block] * (m + 1)), pa.array([None, *side], pa.int32()), pa.array([None, *body], pa.binary()), listed(docs, pa.int64()),
        *(listed(x, pa.int64()) for x in np.concatenate(sizes, 1)), listed(digests, pa.string()), pa.nulls(m + 1, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "side", "body", "doc_ids", "n_a", "n_b", "n_groups", "groups", "shares"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every text once; blocks with their documents and postings. One pass, no shuffle."""

    def run(batches):
        from pyspark import TaskContext

        give_back()
        pair, number = Pair.of(byte_path, piece_path), TaskContext.get().partitionId() << 32
        ids, texts, letters = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                letters += len(text or "")
                if len(ids) >= BLOCK_DOCS or letters >= BLOCK_LETTERS:
                    yield block_rows(number, ids, pair, texts)
                    number, ids, texts, letters = number + 1, [], [], 0
        if ids:
            yield block_rows(number, ids, pair, texts)

    return _texts(docs, id_col, text_col).mapInArrow(run, BLOCKS)


def groups(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every text's groups of ids that cover the same bytes, as `a1,a2|b1;a3|b2,b3`; empty where the sides differ."""

    def run(batches):
        import pyarrow as pa

        give_back()
        pair = Pair.of(byte_path, piece_path)
        for batch in batches:
            told = [pair.align([t])[1][0].decode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["doc_id", "groups"])

    return _texts(docs, id_col, text_col).mapInArrow(run, GROUPS)


def pair_counts(postings: DataFrame) -> DataFrame:
    """Corpus-wide count of every pair: pair (`b << 19 | a`), side, n, best (highest of its B id, ties included).

    Tasks add up their postings before the shuffle. A B id has at most as many pairs as A has ids, which bounds the window.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def packed():
            keys, own = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, np.bincount(own, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for body in batch.column(0):
                keys, per_key, _, n = unpack_postings(body.as_py())
                held.append((keys, np.add.reduceat(n, np.cumsum(per_key) - per_key)))
                size += len(keys)
                if size > PAIRS:
                    held = [packed()]
                    if len(held[0][0]) > PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["pair", "n"])
                        held = []
                    size = sum(len(h[0]) for h in held)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, packed())], ["pair", "n"])

    own = Window.partitionBy("b")
    counts = postings.select("body").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.shiftright("pair", 19))
    return counts.select("pair", (F.shiftright(F.col("b") * 40503, 3) % SIDES).cast("int").alias("side"), "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def _cogrouped(postings: DataFrame, counts: DataFrame, pieces: dict[int, int]) -> DataFrame:
    """Each block's shares: per document of a posting row, links of best pairs and the sum of counts.

    Counts and postings of a range meet in tasks, sorted so that counts come first; postings stream by. A range with many postings
    is several streams, each with the range's counts, so no task grows with a frequent id.
    """
    split = F.coalesce(F.create_map(*(F.lit(x) for kv in pieces.items() for x in kv))[F.col("side")], F.lit(1)) if pieces else F.lit(1)
    none = lambda kind: F.lit(None).cast(kind)
    own = counts.select("side", F.explode(F.sequence(F.lit(0), split - 1)).alias("piece"), F.lit(0).alias("kind"), none("long").alias("block"), "pair", "n", "best", none("binary").alias("body"))
    told = postings.select("side", F.pmod(F.xxhash64("block"), split).cast("int").alias("piece"), F.lit(1).alias("kind"), "block", none("long").alias("pair"), none("long").alias("n"), none("boolean").alias("best"), "body")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, parts, table = None, [], None
        for batch in batches:
            side, piece, kind = (batch.column(i).to_numpy() for i in range(3))
            stream = side.astype(np.int64) << 32 | piece
            edges = np.flatnonzero(np.r_[True, (np.diff(stream) != 0) | (np.diff(kind) != 0), True])
            for x, y in zip(edges.tolist(), edges[1:].tolist()):
                if stream[x] != at:
                    at, parts, table = stream[x], [], None
                rows = batch.slice(x, y - x)
                if not kind[x]:
                    parts.append([rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6)])
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*parts)]
                    parts = []
                shares = []
                for body in rows.column(7):
                    keys, per_key, docs, n = unpack_postings(body.as_py())
                    row = np.repeat(np.searchsorted(table[0], keys), per_key)
                    best = np.bincount(docs, n * table[2][row]).astype(np.int64)
                    total = np.zeros(len(best), np.int64)
                    np.add.at(total, docs, n * table[1][row])
                    shares.append(_planes(best, 8) + _planes(total, 8))
                yield pa.RecordBatch.from_arrays([rows.column(3), pa.array(shares, pa.binary())], ["block", "shares"])

    both = own.unionByName(told).repartition("side", "piece").sortWithinPartitions("side", "piece", "kind", "pair")
    return both.mapInArrow(run, "block long, shares binary")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Groups are cut where ids of both sides end at the same byte of the text with a blank in front. A pair's count is
    how many links of the corpus hold it; n_best counts a document's links whose count is the highest of their B id. Texts that are
    null or empty, or whose bytes the two sides give back differently, have zeros and ''. Repeated rows, repeated and null ids are rows
    like any other; other columns are not read; an empty table gives no rows. A text of any length is one document of one block.
    """
    import pyarrow as pa

    kept = staged(blocks(docs, byte_path, piece_path, id_col, text_col), "alignment-blocks")
    postings = kept.where("side is not null").select("block", "side", "body")
    counts = staged(pair_counts(postings), "alignment-counts")
    sizes = postings.groupBy("side").agg(F.sum(F.length("body")).alias("bytes")).collect()  # SIDES rows at most
    pieces = {r["side"]: int(r["bytes"] // STREAM_BYTES) + 1 for r in sizes}
    shares = _cogrouped(postings, counts, pieces)

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pylist()
        own = next(r for r in rows if r["doc_ids"] is not None)
        n = len(own["doc_ids"])
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in rows:
            if r["shares"]:
                half = len(r["shares"]) // 2
                for into, part in ((best, r["shares"][:half]), (total, r["shares"][half:])):
                    into[: half // 8] += _numbers(part, 8)
        columns = [own["doc_ids"], own["n_a"], own["n_b"], own["n_groups"], own["n_groups"], best, total]
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(own["groups"], pa.string())], [f.split()[0] for f in ALIGNED.split(", ")])

    members = kept.where("side is null").select("block", "doc_ids", "n_a", "n_b", "n_groups", "groups", "shares")
    empty = F.lit(None)
    told = shares.select("block", *(empty.cast(members.schema[c].dataType).alias(c) for c in ("doc_ids", "n_a", "n_b", "n_groups", "groups")), "shares")
    return members.unionByName(told).groupBy("block").applyInArrow(run, ALIGNED)
