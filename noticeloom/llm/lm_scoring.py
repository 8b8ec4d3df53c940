"""Language-model scores of whole texts by a weighted backoff automaton.

States are contexts that were seen in training, arcs smoothed n-grams: an arc carries log10 of
its word's probability after the state. A state without an arc for the next word has a failure
arc to the shorter context, which carries log10 of the mass that is left for unseen words. A
text is walked once from left to right; the walk carries a state and adds up what arcs carry.

No machine holds the whole automaton. Documents go into shards of about SHARD_TOKENS tokens, and
each builds the states and arcs that its own texts can reach: shards send their distinct n-grams
with counts to hash buckets, buckets add them up, and totals come back in the order asked.
Contexts that were seen once have one word after them, so only those seen more often ask for
how many they have. N-grams travel as 64-bit hashes; a count is wrong only if two of them collide.
Shards are written in buckets of their number, so answers travel to them and they stay in place.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, let_go, small_batches, staged, unstage

SHARD_TOKENS = 1_000_000
#: A shard whose words are this large is closed with fewer tokens.
SHARD_BYTES = 1 << 27
#: Tokens of the corpus for each bucket that adds up counts.
BUCKET_TOKENS = 1_000_000
#: Longest n-gram. More orders repeat one exchange of counts each.
ORDER = 3
#: Tokens that are walked in one go; the pieces of a shard's texts are walked side by side.
PIECE = 64

SHARDS = "shard long, doc_ids array<long>, trained array<boolean>, lengths array<int>, tokens binary, words binary"
ASK = "bucket int, shard long, keys binary, counts binary"
ANSWER = "shard long, table string, bucket int, n int, totals binary, first binary"


def _end_key() -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b" ")  # no word holds a blank


def _split(texts):
    """Words of Arrow texts, one after the other, and how many each text has: A-Z made lower, cut at the six ASCII blanks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = pieces.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at a text's ends cut off empty pieces
    each = np.diff(pieces.offsets.to_numpy())
    return flat.filter(pa.array(full)).cast(pa.large_binary()), np.bincount(np.repeat(np.arange(len(each)), each)[full], minlength=len(each))


def shard_tokens(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as shards: ids, whether they train, lengths with the end, token numbers, word hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        ids: list = []
        train: list = []
        words: list = []
        counts: list = []
        size = letters = 0

        def close():
            coded = pa.chunked_array(words, pa.large_binary()).dictionary_encode().combine_chunks()
            lengths = np.concatenate(counts) + 1
            inside = np.ones(lengths.sum(), bool)
            inside[np.cumsum(lengths) - 1] = False
            tokens = np.zeros(len(inside), np.uint32)  # 0 is the end
            tokens[inside] = coded.indices.to_numpy() + 1
            hashes = np.array([_end_key(), *map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())], np.uint64)
            cells = [
                pa.array([part << 24 | nth]), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([_small(tokens)]), pa.array([hashes.tobytes()]),
            ]
            return pa.RecordBatch.from_arrays(cells, ["shard", "doc_ids", "trained", "lengths", "tokens", "words"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                block = batch.slice(at, 256)
                flat, each = _split(block.column(2))
                words.append(flat)
                counts.append(each)
                size += len(flat) + len(each)
                letters += flat.nbytes
                ids += block.column(0).to_pylist()
                train += block.column(1).to_pylist()
                if size >= SHARD_TOKENS or letters >= SHARD_BYTES:
                    yield close()
                    nth, size, letters = nth + 1, 0, 0
                    ids, train, words, counts = [], [], [], []
        if ids:
            yield close()

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col(text_col).cast("string").alias("text"))
    return bucketed(rows.mapInArrow(run, SHARDS), "lm-shards", "shard")


def _fold(words):
    """One 64-bit hash of the words' hashes in their order."""
    import numpy as np

    found = words[0]
    for w in words[1:]:
        found = found * np.uint64(0x9E3779B97F4A7C15) ^ (w + (found >> np.uint64(29)))
        found = found * np.uint64(0xBF58476D1CE4E5B9)
        found = found ^ found >> np.uint64(32)
    return found


class Corpus:
    """A shard's arrays, and its n-grams as hashes."""

    def __init__(self, row: dict):
        import numpy as np

        self.lengths = np.array(row["lengths"], np.int64)
        planes = np.frombuffer(row["tokens"], np.uint8).reshape(4, -1).T  # byte by byte: numbers are small
        self.tokens = np.ascontiguousarray(planes).view(np.uint32).ravel()
        self.words = np.frombuffer(row["words"], np.uint64)
        self.trained = np.repeat(np.array(row["trained"], bool), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.starts, self.inside = starts, np.arange(len(self.tokens)) - np.repeat(starts, self.lengths)
        self.tables: dict = {}

    def before(self, k: int):
        """Hash of the word k places earlier; before a text stands its end, again and again."""
        import numpy as np

        own = self.words[self.tokens]
        if k:
            own = np.where(self.inside >= k, np.roll(own, k), np.uint64(_end_key()))
        return own

    def table(self, n: int):
        """Sorted distinct n-grams as hashes, a token where each ends, and each token's n-gram among them."""
        import numpy as np

        if n not in self.tables:
            if n > 1:
                self.tables[n] = _distinct(_fold([self.before(k) for k in range(n - 1, -1, -1)]))
            else:  # the words themselves: each stands in some text
                order = np.argsort(self.words)
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                own, at = number[self.tokens], np.empty(len(order), np.int64)
                at[own] = np.arange(len(own))
                self.tables[n] = self.words[order], at, own
        return self.tables[n]

    def contexts(self, n: int):
        """At each token its context among the (n-1)-grams, or their number at a text's first token.

        The context that stands before texts ends no (n-1)-gram that is a context elsewhere: no word follows an end.
        """
        import numpy as np

        keys, _, own = self.table(n - 1)
        return np.where(self.inside > 0, np.roll(own, 1), len(keys))

    def asking(self, n: int, entered):
        """Contexts that were seen more than once, as numbers and hashes in order of hashes. Of the others it is known how many words follow."""
        import numpy as np

        keys = np.append(self.table(n - 1)[0], _fold(np.full((n - 1, 1), _end_key(), np.uint64)))
        used = np.zeros(len(keys), bool)
        used[self.contexts(n)] = True
        at = np.flatnonzero(used & (entered > 1))
        at = at[np.argsort(keys[at], kind="stable")]
        return at, keys[at]


def _distinct(keys):
    """Sorted distinct keys, where each stands first or later, and each place's number among them."""
    import numpy as np

    order = np.argsort(keys)
    told = keys[order]
    new = np.ones(len(told), bool)
    new[1:] = told[1:] != told[:-1]
    own = np.empty(len(told), np.int64)
    own[order] = np.cumsum(new) - 1
    return told[new], order[new], own


def _planes(keys) -> bytes:
    """Sorted keys as differences, byte by byte: their leading zeros compress."""
    import numpy as np

    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes):
    import numpy as np

    steps = np.frombuffer(planes, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def _small(numbers) -> bytes:
    """Numbers below 2^32, byte by byte: most are small, so most bytes are zeros in a row."""
    import numpy as np

    return np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _cuts(keys, buckets: int):
    """Where each bucket's keys begin: a bucket is a range of hashes."""
    import numpy as np

    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def _asked(shard: int, keys, counts, buckets: int):
    import numpy as np
    import pyarrow as pa

    cut = _cuts(keys, buckets)
    full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    cells = [[b for b in full], [shard] * len(full), [_planes(keys[cut[b] : cut[b + 1]]) for b in full], [_small(counts[cut[b] : cut[b + 1]]) for b in full]]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "shard", "keys", "counts"])


def _add_up(asked: DataFrame, name: str) -> DataFrame:
    """Totals of every key over all shards, in the order each shard asked.

    `first` marks, for each key with a total, one shard that counted it, so that shards
    can count distinct keys without counting any twice. Rows with shard -1 hold sums of
    the bucket: total, distinct keys, keys counted once and twice.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        rows = table.to_pylist()
        keys = [_keys(r["keys"]) for r in rows]
        counts = [_numbers(r["counts"]) for r in rows]
        every, own = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(counts)
        total = np.bincount(own, n, len(every)).astype(np.int64)
        at = np.flatnonzero(n > 0)[::-1]
        owner = np.full(len(every), -1)
        owner[own[at]] = at
        first = np.zeros(len(n), bool)
        first[owner[owner >= 0]] = True
        ends = np.cumsum([len(k) for k in keys])[:-1]
        bucket = rows[0]["bucket"]
        sums = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
        return pa.Table.from_arrays(
            [
                pa.array([-1, *(r["shard"] for r in rows)], pa.int64()), pa.array([name] * (len(rows) + 1)), pa.array([bucket] * (len(rows) + 1), pa.int32()),
                pa.array([0, *map(len, keys)], pa.int32()),
                pa.array([sums.tobytes(), *(_small(x) for x in np.split(total[own], ends))], pa.binary()),
                pa.array([b"", *(np.packbits(x).tobytes() for x in np.split(first, ends))], pa.binary()),
            ],
            ["shard", "table", "bucket", "n", "totals", "first"],
        )

    return staged(asked.groupBy("bucket").applyInArrow(run, ANSWER), f"lm-{name}")


def _sums(answer: DataFrame) -> list[int]:
    """The buckets' sums added up: one row a bucket reaches the driver."""
    import numpy as np

    rows = [np.frombuffer(r["totals"], np.int64) for r in answer.where("shard = -1").select("totals").collect()]
    return np.sum(rows, 0).tolist() if rows else [0, 0, 0, 0]


def _totals(rows: list[dict], name: str):
    """A shard's totals of one table, in key order."""
    import numpy as np

    own = sorted((r for r in rows if r["table"] == name), key=lambda r: r["bucket"])
    return np.concatenate([_numbers(r["totals"]) for r in own]) if own else np.zeros(0, np.int64)


def _marks(rows: list[dict], name: str):
    """A shard's marks of the keys of one table that it was first to count, in key order."""
    import numpy as np

    own = sorted((r for r in rows if r["table"] == name), key=lambda r: r["bucket"])
    return np.concatenate([np.unpackbits(np.frombuffer(r["first"], np.uint8), count=r["n"]) for r in own]).astype(bool) if own else np.zeros(0, bool)


class Automaton:
    """States, arcs and failure arcs. State 0 is the empty context; it has an arc for every known word, and others cost `unknown`.

    `arc` is sorted: state << 32 | word. `weight` and `then` are an arc's log10 probability and next state; `fail` and
    `fail_weight` lead from a state to the shorter one; `start` is the state before a text.
    """

    def __init__(self, arc, weight, then, fail, fail_weight, unknown: float, start: int):
        import numpy as np

        order = np.argsort(arc)
        self.arc, self.weight, self.then = np.append(arc[order], np.iinfo(np.int64).max), np.append(weight[order], 0.0), np.append(then[order], 0)
        self.fail, self.fail_weight, self.unknown, self.start = fail, fail_weight, unknown, start

    def step(self, state, word):
        """Next states and log10 probabilities of words after states."""
        import numpy as np

        told, then = np.zeros(len(word)), np.zeros(len(word), np.int64)
        todo, state = np.arange(len(word)), state.copy()
        while len(todo):
            own = state[todo]
            key = (own << 32) | word[todo]
            ascending = np.argsort(key)  # neighbours in the table are looked up one after the other
            at = np.empty(len(key), np.int64)
            at[ascending] = np.searchsorted(self.arc, key[ascending])
            hit = self.arc[at] == key
            done = todo[hit]
            told[done] += self.weight[at[hit]]
            then[done] = self.then[at[hit]]
            root = ~hit & (own == 0)
            told[todo[root]] += self.unknown
            todo, own = todo[~hit & ~root], own[~hit & ~root]
            told[todo] += self.fail_weight[own]
            state[todo] = self.fail[own]
        return then, told

    def walk(self, tokens, starts, lengths, warm: int, piece: int = PIECE):
        """log10 probability of every token. Texts are cut into pieces that are walked side by side.

        A state holds at most `warm` words, so a piece within a text finds its first state by walking the `warm` words before it.
        """
        import numpy as np

        told = np.zeros(len(tokens))
        pieces = -(-lengths // piece)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(starts, pieces) + nth * piece
        end = np.minimum(begin + piece, np.repeat(starts + lengths, pieces))
        back = np.where(nth > 0, warm, 0)
        longest = np.argsort(begin - back - end, kind="stable")
        begin, end, back, first = begin[longest], end[longest], back[longest], nth[longest] == 0
        at, state = begin - back, np.where(first, self.start, 0)
        size = end - at
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, "left"))  # pieces stand in order of size
            here = at[:live] + k
            state[:live], gained = self.step(state[:live], tokens[here])
            scored = here >= begin[:live]
            told[here[scored]] = gained[scored]
        return told


def automaton(corpus: Corpus, counts: dict, after: dict, discount: dict, n_train: int, n_words: int, n_texts: int, order: int) -> Automaton:
    """A shard's automaton. `counts[n]` are totals of its sorted distinct n-grams, `after[n]` the distinct words after its contexts.

    Smoothing is absolute discounting interpolated down to the base estimate; an n-gram's arc holds the interpolated share.
    """
    import numpy as np

    words = corpus.tokens.astype(np.int64)
    last = np.zeros(len(words), bool)
    last[corpus.starts + corpus.lengths - 1] = True
    state = np.zeros(len(words), np.int64)  # at every token the context of n - 1 words, where it was seen
    arcs, weights, first, fails, fail_weights, n_states = [], [], [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
    nexts, at_start = [], [0]
    for n in range(1, order + 1):
        _, one, own = corpus.table(n)
        known = counts[n][own]
        if n == 1:
            share = (known + 0.5) / (n_train + 0.5 * (n_words + 1))
        else:
            # A context was left as often as it was entered: that is its own count; texts' starts count as ends.
            entered, which = np.append(counts[n - 1], n_texts), corpus.contexts(n)
            left = np.maximum(entered, 1)
            mass = np.where(entered > 0, discount[n] * after[n] / left, 1.0)
            share = np.where(known > 0, np.maximum(known - discount[n], 0) / left[which], 0.0) + mass[which] * share
            at = np.full(len(entered), -1)
            at[which] = np.arange(len(which))
            real = (entered > 0) & (at >= 0)
            number = np.cumsum(real) - 1 + n_states
            fails.append(state[at[real]])
            fail_weights.append(np.log10(mass[real]))
            longer = np.where(real[which], number[which], -1)
            n_states += int(real.sum())
            nexts.append(np.where(last, 0, np.roll(longer, -1)))
            state = longer
            at_start.append(int(longer[corpus.starts[0]]))
        one = one[(known[one] > 0) & (state[one] >= 0)]
        arcs.append((state[one] << 32) | words[one])
        weights.append(np.log10(share[one]))
        first.append(one)
    # After an arc of n words the context has them all, or the last order - 1.
    then = [nexts[min(n, len(nexts) - 1)][one] if nexts else np.zeros(len(one), np.int64) for n, one in enumerate(first)]
    start = next((x for x in reversed(at_start) if x >= 0), 0)
    unknown = float(np.log10(0.5 / (n_train + 0.5 * (n_words + 1))))
    return Automaton(np.concatenate(arcs), np.concatenate(weights), np.maximum(np.concatenate(then), 0), np.concatenate(fails), np.concatenate(fail_weights), unknown, start)


def score_texts(docs: DataFrame, trained: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row's whole text under a model of the rows where `trained` holds.

    Columns: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score. Null and
    empty texts are their end alone. Repeated rows count and score each; null ids stay null;
    an empty table gives no rows, and without training rows every word has the share of an
    unknown one. Smoothing is absolute discounting (n1 / (n1 + 2 n2) at each order), so the words
    after a context and one unknown word have probabilities that sum to 1.
    """
    shards = shard_tokens(docs, trained, id_col, text_col)
    tokens, texts = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x), F.size(F.filter("trained", lambda t: t))
    apart = docs.sparkSession.read.schema(shards.schema).parquet(shards.staged_at)  # the same rows in as few tasks as their files fill
    sizes = apart.agg(F.sum(tokens).alias("tokens"), F.sum(texts).alias("texts")).first()
    buckets, n_texts = max(16, -(-(sizes["tokens"] or 0) // BUCKET_TOKENS)), sizes["texts"] or 0

    def count(n: int):
        def run(batches):
            import numpy as np

            for batch in batches:
                for row in batch.to_pylist():
                    corpus = Corpus(row)
                    keys, _, own = corpus.table(n)
                    yield from _asked(row["shard"], keys, np.bincount(own[corpus.trained], minlength=len(keys)), buckets).to_batches()

        return run

    def distinct_after(n: int):
        """Contexts of order n with how many distinct words this shard was first to count after them."""

        def run(left, right):
            import numpy as np
            import pyarrow as pa

            out, answered = [], right.to_pylist()
            for row in left.to_pylist():
                corpus = Corpus(row)
                entered = np.append(_totals(answered, f"count{n - 1}"), n_texts)
                at, keys = corpus.asking(n, entered)
                one = corpus.table(n)[1][_marks(answered, f"count{n}")]
                out.append(_asked(row["shard"], keys, np.bincount(corpus.contexts(n)[one], minlength=len(entered))[at], buckets))
            return pa.concat_tables(out) if out else _asked(0, np.zeros(0, np.uint64), np.zeros(0), 1)

        return run

    def replies(answer: DataFrame, *cells: str) -> DataFrame:
        """Answers to the shards, with those of the cells `totals` and `first` that are asked for."""
        return answer.where("shard >= 0").select("shard", "table", "bucket", "n", *(F.col(c) if c in cells else F.lit(None).cast("binary").alias(c) for c in ("totals", "first")))

    counts, afters, stats = {}, {}, {}
    for n in range(1, order + 1):
        counts[n] = _add_up(apart.mapInArrow(count(n), ASK), f"count{n}")
        stats[n] = _sums(counts[n])
        let_go(docs.sparkSession)
        if n > 1:
            told = replies(counts[n - 1], "totals").unionByName(replies(counts[n], "first"))
            afters[n] = _add_up(shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(distinct_after(n), ASK), f"after{n}")
            del told
            let_go(docs.sparkSession)
    discount = {n: min(0.95, max(0.1, stats[n][2] / max(1, stats[n][2] + 2 * stats[n][3]))) for n in range(2, order + 1)}
    n_train, n_words = stats[1][0], stats[1][1]

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = []
        answered = right.to_pylist()
        for row in left.to_pylist():
            corpus = Corpus(row)
            totals = {n: _totals(answered, f"count{n}") for n in range(1, order + 1)}
            seen = totals[1][corpus.table(1)[2]]
            share = (seen + 0.5) / (n_train + 0.5 * (n_words + 1))
            base = np.add.reduceat(np.log10(share), corpus.starts)
            known = np.add.reduceat((seen > 0).astype(np.int64), corpus.starts)
            after = {}
            for n in range(2, order + 1):
                entered = np.append(totals[n - 1], n_texts)
                after[n] = (entered == 1).astype(np.int64)
                after[n][corpus.asking(n, entered)[0]] = _totals(answered, f"after{n}")
            model = automaton(corpus, totals, after, discount, n_train, n_words, n_texts, order)
            corpus.tables.clear()
            score = np.add.reduceat(model.walk(corpus.tokens.astype(np.int64), corpus.starts, corpus.lengths, order - 1), corpus.starts)
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "trained": pa.array(row["trained"], pa.bool_()), "n_tokens": corpus.lengths,
                "n_known": known, "train_tokens": np.full(len(base), n_train), "base_score": base, "score": score,
            }))
        return pa.concat_tables(out)

    answers = [*counts.values(), *afters.values()]
    told = functools.reduce(DataFrame.unionByName, (replies(a, "totals") for a in answers))
    schema = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = staged(shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, schema), "lm-scores")
    del told
    unstage(shards, *answers)
    return scores
