"""Documents whose word shingles have a Jaccard similarity of at least num / den: an exact join.

Equal sets meet first and count once. Of every other set the rarest shingles are its prefix:
as many as it may lack in a partner, and one more, so linked sets share one. Sizes fall into
bands so wide that linked sets lie in one band or in neighbours; a shingle and a band name a
tile, and a set stands in the tiles of its band and of the next, so unequal sizes never meet.
A pair of a tile survives if the bits of hashed bitmaps, one per set, allow enough common
shingles; survivors are decided by intersecting the sorted shingle arrays. No step loses a link.

Tiles do not emit all their pairs: first each set meets the tile's head only, and of these the one that it shares most tiles with before the others; then those sets meet whose
components still differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, give_back, small_batches, staged, text_bytes, unstage

#: Bits of a set's bitmap: twice its size to the next power of two, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 15
#: Shingles known as frequent: they go last in the order of rarity. Only speed depends on them.
FREQUENT, FREQUENT_FROM = 1 << 20, 8
#: Members of a tile that meet in one block; longer tiles meet block by block.
TILE = 256


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the whole text: A-Z lowered, parted by the six ASCII blanks."""
    return (text or b"").lower().split()


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of `n` words; all words, if fewer."""

    def __init__(self, n: int):
        self.n, self.number, self.hashes = n, {}, None

    def block(self, texts: list) -> list:
        import numpy as np
        import xxhash

        lists = [words_of(t) for t in texts]
        if len(self.number) > 200_000:
            self.number, self.hashes = {}, None
        new = list(set().union(*lists).difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        fresh = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)
        self.hashes = fresh if self.hashes is None else np.concatenate([self.hashes, fresh])
        get, out = self.number.__getitem__, []
        for words in lists:
            own = self.hashes[np.fromiter(map(get, words), np.int64, len(words))]
            if not len(own):
                out.append(own)
                continue
            k = min(self.n, len(own))
            found = own[: len(own) - k + 1].copy()
            for j in range(1, k):
                found = found * np.uint64(0x9E3779B97F4A7C15) ^ (own[j : len(own) - k + 1 + j] + (found >> np.uint64(29)))
                found = found * np.uint64(0xBF58476D1CE4E5B9)
                found ^= found >> np.uint64(32)
            found.sort()
            keep = np.ones(len(found), bool)
            keep[1:] = found[1:] != found[:-1]
            out.append(found[keep])
        return out


def prefix_length(size: int, num: int, den: int) -> int:
    """Shingles of a set that may be missing in a partner, and one more."""
    return size - -(-num * size // den) + 1


def bitmap(shingles):
    """Hashed bitmap of a set, as bytes."""
    import numpy as np

    width = LEAST_BITS
    while width < 2 * len(shingles) and width < MOST_BITS:
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """Whether bit counts leave room for enough common shingles. Every bit that only one set
    has is a shingle that the other lacks. A wider bitmap folds onto a narrower one."""
    import numpy as np

    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    common = int(np.bitwise_count(x & y).sum())
    most = min(na - (int(np.bitwise_count(x).sum()) - common), nb - (int(np.bitwise_count(y).sum()) - common))
    return den * most >= num * (na + nb - most)


def frequent_shingles(docs: DataFrame, n: int):
    """Shingles that recur within tasks, the most frequent FREQUENT of them, sorted. Bounded."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        give_back()
        shingler, gathered, size = Shingler(n), [], 0

        def recurring():
            found, times = np.unique(np.concatenate(gathered), return_counts=True)
            twice = times > 1
            return pa.RecordBatch.from_arrays([pa.array(found[twice].view(np.int64)), pa.array(times[twice])], ["shingle", "n"])

        for batch in batches:
            texts = text_bytes(batch.column(0))
            for at in range(0, len(texts), 256):
                gathered += shingler.block(texts[at : at + 256])
                size += sum(map(len, gathered[-256:]))
                if size > 2_000_000:
                    yield recurring()
                    gathered, size = [], 0
        if gathered:
            yield recurring()

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    rows = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


SETS = "doc_id long, text_key long, n_shingles long, set_hi long, set_lo long, bits binary, prefix array<long>"


def shingle_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, text_key, size of its set, 128 bits that name the set, bitmap, prefix."""
    import numpy as np

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def run(batches):
        import pyarrow as pa
        import xxhash

        give_back()
        shingler, often = Shingler(n), frequent.value
        sent: set = set()
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for at in range(0, len(texts), 256):
                sizes, high, low, bits, prefixes = [], [], [], [], []
                for k, own in zip(batch.column(0).slice(at, 256).is_valid().to_pylist(), shingler.block(texts[at : at + 256])):
                    name = xxhash.xxh128_digest(own.tobytes())
                    sizes.append(len(own))
                    high.append(int.from_bytes(name[:8], "big", signed=True))
                    low.append(int.from_bytes(name[8:], "big", signed=True))
                    if not k or name in sent or not len(own):  # a row without an id sends nothing, a task a set's tiles and bits once
                        bits.append(None)
                        prefixes.append(np.zeros(0, np.int64))
                        continue
                    if len(sent) < 200_000:
                        sent.add(name)
                    bits.append(bitmap(own))
                    common = np.zeros(len(own), bool)
                    if len(often):
                        common = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own
                    prefixes.append(np.concatenate([own[~common], own[common]])[: prefix_length(len(own), num, den)].view(np.int64))
                cells = [batch.column(0).slice(at, 256), batch.column(1).slice(at, 256), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "text_key", "n_shingles", "set_hi", "set_lo", "bits", "prefix"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, SETS)


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, name: str) -> DataFrame:
    """Of pairs (a, b) of representatives those that link. Bit counts first, then the sorted arrays."""
    import numpy as np

    def allowed(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [may_link(a, b, x, y, num, den) for x, y, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (reps.select(F.col("rep").alias(k), F.col("size").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    left = staged(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(allowed, "a long, b long"), f"{name}-survivors")
    # Written first: its size is then known, and Spark sends a small list of ids to the texts, not texts to the ids.
    ends = left.select(F.col("a").alias("rep")).union(left.select(F.col("b").alias("rep"))).distinct()
    members = staged(ends.join(reps, "rep").select("rep", "doc_id", "text_key"), f"{name}-members")

    def arrays(batches):
        import pyarrow as pa

        shingler = Shingler(n)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([x.tobytes() for x in shingler.block(texts[at : at + 256])], pa.binary())], ["id", "own"])

    sets = staged(docs.join(members, ["doc_id", "text_key"]).select("rep", "text").mapInArrow(arrays, "id long, own binary").groupBy("id").agg(F.first("own").alias("own")), f"{name}-arrays")

    def decided(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = left.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    links = staged(joined.select("a", "b", "x", "y").mapInArrow(decided, "u long, v long"), f"{name}-links")
    del joined, ends
    unstage(left, members, sets)
    return links


def banded(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of `tiles` (key, rep, size) in the band of their size and in the next one, as column band.

    Band k holds the sizes from (den / num)^k on, so a size and one that it may link with are in
    one band or in neighbours, and stand together in the upper one of their bands.
    """
    # Sizes at a band's very edge must not fall on either side of it by rounding. Only equal sizes link where num = den.
    band = F.floor(F.log("size") / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int") if num < den else F.col("size").cast("int")
    return tiles.withColumn("band", F.explode(F.array(band, band + 1)))


def outside(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) that are in different components."""
    for k in "ab":
        pairs = pairs.join(found.select(F.col("id").alias(k), F.col("component").alias(f"component_{k}")), k, "left")
    return pairs.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def sizes_allow(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def met_in_blocks(tiles: DataFrame, reps: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a, b) of long tiles whose components differ and whose bit counts allow a link.

    A tile's sets fall into blocks by hash and blocks meet two at a time, each two in a group
    of their own, so no group holds a tile and only pairs that may link leave it.
    """
    from functools import reduce

    import numpy as np

    cut = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), cut).cast("int")
    told = tiles.join(reps.select("rep", "bits"), "rep").withColumn("own", own)
    met = told.withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1))).select(
        "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "size", "component", "bits"
    )

    def run(table):
        import pyarrow as pa

        own, ids, size, component = (table.column(c).to_numpy() for c in ("own", "rep", "size", "component"))
        bits = [np.frombuffer(b, np.uint64) for b in table.column("bits").to_pylist()]
        width = min(map(len, bits))
        flat = np.stack([reduce(np.bitwise_or, b.reshape(-1, width)) for b in bits])
        ones = np.bitwise_count(flat).sum(1).astype(np.int64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pairs = []
        for x in left.tolist():
            y = right[(component[right] != component[x]) & ((ids[right] > ids[x]) | (i != j))]
            common = np.bitwise_count(flat[x] & flat[y]).sum(1).astype(np.int64)
            most = np.minimum(size[x] - (ones[x] - common), size[y] - (ones[y] - common))
            y = y[(den * most >= num * (size[x] + size[y] - most)) & (most <= np.minimum(size[x], size[y]))]
            pairs += [(min(ids[x], v), max(ids[x], v)) for v in ids[y].tolist()]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("key", "band", "i", "j").applyInArrow(run, "a long, b long")


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", block: int = TILE, by_text: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two texts link when den * common >= num * union of their sets of distinct `n`-word
    shingles; a text with fewer words has one shingle of them all. Null texts and texts
    without words have no shingle and no link. Repeated ids and rows each get a row; a null
    id stays null and represents nothing, but its row joins the component of equal sets. An
    empty table gives no rows; columns besides id and text are ignored.
    An id on several texts links none of them. With `by_text` also text_key, xxhash64 of the text, and stays: false on all
    rows of a component but those with its smallest id and one text of it; rows without an id or words stay.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sets = staged(shingle_sets(rows, n, num, den), "shingle-sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    # Sets are numbered, as an id can stand on several; a set's smallest id and that row's text represent it.
    least = full.groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("n_shingles").alias("size"))
    names = staged(least.select("set_hi", "set_lo", "least.*", "size").withColumn("rep", F.monotonically_increasing_id()), "shingle-reps")
    sent = full.where("bits is not null").join(names.select("set_hi", "set_lo", "rep", "size"), ["set_hi", "set_lo"])
    sent = staged(sent.select("rep", "size", "bits", "prefix"), "shingle-prefixes")
    told = staged(sets.select("doc_id", "text_key", "n_shingles", "set_hi", "set_lo"), "shingle-rows")
    del full, least
    unstage(sets)
    reps = staged(sent.groupBy("rep").agg(F.first("bits").alias("bits")).join(names, "rep").select("rep", "doc_id", "text_key", "size", "bits"), "shingle-bits")
    # Shingles in the prefixes of two sets at least. Tasks may send a set twice, so least and most are told apart, not counted.
    keys = sent.select(F.explode("prefix").alias("key"), "rep", "size")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    tiles = staged(keys.join(shared, "key"), "tiles")
    del keys, shared
    unstage(sent)
    # First every set meets its tile's head, if their sizes allow a link: the set that most others share shingles with, as a
    # text does of which many edited copies stand around; copies of it may be too far from each other to link.
    weight = tiles.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    tile = banded(tiles.join(weight, "rep"), num, den)
    heads = tile.groupBy("key", "band").agg(F.max(F.struct("shared", "rep", "size")).alias("head"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").drop("lo", "hi")
    stars = tile.join(heads, ["key", "band"]).where(F.col("rep") != F.col("head.rep")).where(sizes_allow(F.col("size"), F.col("head.size"), num, den))
    first = staged(stars.groupBy(F.least("head.rep", "rep").alias("a"), F.greatest("head.rep", "rep").alias("b"), F.col("rep").alias("of")).agg(F.count(F.lit(1)).alias("n")), "star-pairs")
    best = staged(first.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("n", "a", "b")).alias("p")).select("p.*").distinct(), "best-stars")
    links = linked(best, reps, rows, n, num, den, "star")
    found = connected_components(links, "star-components")
    apart = staged(outside(first.select("a", "b").distinct(), found).join(best, ["a", "b"], "left_anti"), "other-stars")
    links = links.union(linked(apart, reps, rows, n, num, den, "other"))
    unstage(found, best, apart)
    found = connected_components(links, "other-components")
    # Then sets of one tile whose components differ.
    own = banded(tiles.distinct(), num, den).join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = own.groupBy("key", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("key", "band", "members")
    open_tiles = staged(own.join(mixed, ["key", "band"]).select("key", "band", "rep", "size", "members", "component"), "open-tiles")
    del tile, own, mixed, stars, heads, weight
    unstage(tiles, found)
    one, two = (open_tiles.select("key", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "size", "component")), "members") for k in "ab")
    short = F.col("members") <= block
    across = one.where(short).join(two.where(short).drop("members"), ["key", "band"]).where("rep_a < rep_b and component_a <> component_b").where(sizes_allow(F.col("size_a"), F.col("size_b"), num, den))
    candidates = across.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).union(met_in_blocks(open_tiles.where(~short), reps, num, den, block))
    second = staged(candidates.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), "cross-pairs")
    del one, two, across, candidates
    unstage(open_tiles, first)
    more = linked(second, reps, rows, n, num, den, "cross")
    final = connected_components(links.union(more), "components")
    by_set = names.join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    label = by_set.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("label"))
    by_set = staged(by_set.join(label, "component").select("set_hi", "set_lo", "label"), "shingle-labels")
    del label
    unstage(second, reps, more, names, final)
    named = told.join(by_set, ["set_hi", "set_lo"], "left")
    stays = F.col("doc_id").isNull() | F.col("label").isNull() | (F.col("label") == F.struct("doc_id", "text_key"))
    out = named.withColumn("stays", stays).withColumn("component_id", F.coalesce("label.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", *(("text_key", "stays") if by_text else ()))
