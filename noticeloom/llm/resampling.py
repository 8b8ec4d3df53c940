"""Importance resampling towards a target: hashed n-gram buckets, gains, and a seeded draw.

Each task runs DuckDB over its own blocks of texts: SQL unnests words, a window reads the words
that follow, a registered CRC gives every n-gram its bucket, and counts by document and bucket
come out. Spark spills them to Parquet in the shared folder, merges the buckets' totals and scores
every document from its counts.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import ranked
from .shared import give_back, small_batches, staged

#: Letters of text that one run of the SQL takes; a longer text is a run of its own.
BLOCK_LETTERS = 2_000_000
#: Words: letters a-z, digits and all beyond ASCII, after A-Z are lower case.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The reversed polynomial of zlib's CRC, and the lengths that have tables of their own.
POLYNOMIAL, SHORT = 0xEDB88320, 96

COUNTED = "key long, doc_id long, n_words long, buckets array<int>, counts array<long>"


class Crc:
    """CRCs of joined strings from the CRCs of their parts, for arrays."""

    def __init__(self):
        import numpy as np

        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = byte >> 1 ^ np.where(byte & 1, np.uint32(POLYNOMIAL), np.uint32(0))
        #: short[n][k][v]: what byte k of a CRC, of value v, becomes after n zero bytes; power[j]: after 2^j.
        self.short = np.zeros((SHORT, 4, 256), np.uint32)
        self.short[0] = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
        for n in range(1, SHORT):
            self.short[n] = self.short[n - 1] >> np.uint32(8) ^ byte[self.short[n - 1] & np.uint32(255)]
        self.power = [self.short[1]]
        for _ in range(40):
            self.power.append(self._moved(self.power[-1][None], 0, self.power[-1]))

    @staticmethod
    def _moved(tables, n, crc):
        return tables[n, 0, crc & 255] ^ tables[n, 1, crc >> 8 & 255] ^ tables[n, 2, crc >> 16 & 255] ^ tables[n, 3, crc >> 24]

    def joined(self, first, second, size):
        """The CRC of two strings one after the other, from the CRC of each and the bytes of the second."""
        import numpy as np

        crc = first.astype(np.uint32)
        out = self._moved(self.short, np.minimum(size, SHORT - 1), crc)
        long_ = np.flatnonzero(size >= SHORT)
        if len(long_):
            moved, left = crc[long_], size[long_]
            for j, table in enumerate(self.power):
                at = np.flatnonzero(left >> j & 1)
                moved[at] = self._moved(table[None], 0, moved[at])
            out[long_] = moved
        return out ^ second.astype(np.uint32)


def connection():
    """DuckDB in memory, on one thread and without files of its own, with the CRC functions."""
    import duckdb
    import numpy as np
    import pyarrow as pa

    crc = Crc()

    def of_strings(words):
        return pa.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], pa.int64())

    def of_joined(first, second, size):
        return pa.array(crc.joined(*(x.to_numpy(zero_copy_only=False) for x in (first, second, size))).astype(np.int64))

    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute("SET temp_directory = ''")
    db.create_function("crc32", of_strings, ["VARCHAR"], "BIGINT", type="arrow")
    db.create_function("crc32_joined", of_joined, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
    return db


def bucket_counts(db, texts, longest: int, buckets: int):
    """(doc, bucket, n) of a table (doc, text), by doc and bucket, and (doc, words): n-grams of 1 to `longest` words."""
    db.register("texts", texts)
    db.execute(f"""CREATE OR REPLACE TEMP TABLE words AS SELECT doc, unnest(w) AS word, generate_subscripts(w, 1) AS place
        FROM (SELECT doc, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM texts)""")
    # A word's CRC is worked out once; `after` and `size` are those of the word with a blank in front.
    db.execute("""CREATE OR REPLACE TEMP TABLE known AS SELECT word, own, crc32_joined(blank, own, strlen(word)) AS after, strlen(word) + 1 AS size
        FROM (SELECT word, crc32(word) AS own FROM (SELECT DISTINCT word FROM words)), (SELECT crc32(' ') AS blank)""")
    leads = "".join(f", lead(after, {k}) OVER follows AS after{k}, lead(size, {k}) OVER follows AS size{k}" for k in range(1, longest))
    db.execute(f"""CREATE OR REPLACE TEMP TABLE followed AS SELECT doc, own AS gram1{leads}
        FROM words JOIN known USING (word) WINDOW follows AS (PARTITION BY doc ORDER BY place)""")
    # Each longer n-gram is the one before it and the next word.
    inner, grams = "followed", ["SELECT doc, gram1 AS gram FROM followed"]
    for k in range(1, longest):
        inner = f"(SELECT *, crc32_joined(gram{k}, after{k}, size{k}) AS gram{k + 1} FROM {inner} WHERE after{k} IS NOT NULL)"
        grams.append(f"SELECT doc, gram{k + 1} AS gram FROM {inner}")
    found = db.sql(f"SELECT doc, CAST(gram % {buckets} AS INTEGER) AS bucket, count(*) AS n FROM ({' UNION ALL '.join(grams)}) GROUP BY ALL ORDER BY ALL").to_arrow_table()
    words = db.sql("SELECT doc, count(*) AS n FROM words GROUP BY doc ORDER BY doc").to_arrow_table()
    db.unregister("texts")
    return found, words


def counted(docs: DataFrame, longest: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, doc_id, n_words, and its buckets with counts. A row without a key holds a task's totals by bucket. One pass, no shuffle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        give_back()
        db, key, totals = connection(), TaskContext.get().partitionId() << 40, np.zeros(buckets, np.int64)
        names = [f.split()[0] for f in COUNTED.split(", ")]

        def counts(ids: list, texts: list):
            nonlocal key, totals
            n = len(ids)
            found, words = bucket_counts(db, pa.table({"doc": pa.array(range(n), pa.int32()), "text": pa.array(texts, pa.string())}), longest, buckets)
            doc, bucket, count = (c.to_numpy() for c in found.columns)
            totals += np.bincount(bucket, count, buckets).astype(np.int64)
            n_words = np.zeros(n, np.int64)
            n_words[words.column(0).to_numpy()] = words.column(1).to_numpy()
            offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (bucket, count.astype(np.int64))]
            key += n
            return pa.RecordBatch.from_arrays([pa.array(range(key - n, key), pa.int64()), pa.array(ids, pa.int64()), pa.array(n_words), *lists], names)

        ids, texts, letters = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and letters + len(text or "") > BLOCK_LETTERS:
                    yield counts(ids, texts)
                    ids, texts, letters = [], [], 0
                ids.append(doc)
                texts.append(text or "")
                letters += len(text or "")
        if ids:
            yield counts(ids, texts)
        at = np.flatnonzero(totals)
        lists = [pa.array([x], pa.list_(k)) for x, k in ((at.astype(np.int32), pa.int32()), (totals[at], pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *lists], names)
        db.close()

    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, COUNTED)


def totals(counts: DataFrame) -> DataFrame:
    """bucket and n over all tasks: as many rows as there are buckets at most."""
    pairs = counts.where("key is null").select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain in thousandths: log of its smoothed share in the target over that in the source, floored."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").na.fill(0)
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    gain = lambda s, t: F.floor(1000 * F.log((t + 1.0) * F.lit(sums["S"] + float(buckets)) / ((s + 1.0) * F.lit(sums["T"] + float(buckets)))))
    out = [0] * buckets  # a bucket that neither side has is asked for by no document
    for r in both.select("bucket", gain(F.col("s"), F.col("t")).alias("gain")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["gain"]
    return out


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Per row of `docs`: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Features are all runs of 1 to `longest` words; weight is the floored mean of their buckets' gains towards `target`, 0 without
    features. score adds a Gumbel variate of the id, so that drawing the highest scores samples in proportion to the weights. Of
    the rows with at least `least_words` words, `percent` per cent are drawn, by score, then id (null ids last); rows that repeat an id are rows
    like any other, in an order of their own. Null and empty texts have no features; null ids draw as the empty string. An empty
    `docs` gives no rows; an empty `target` makes rare buckets gain. Other columns are not read.
    """
    import numpy as np

    counts = staged(counted(docs, longest, buckets, id_col, text_col), "bucket-counts")
    aimed = staged(counted(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_text_col}`").alias("text")), longest, buckets).where("key is null"), "target-counts")
    table = docs.sparkSession.sparkContext.broadcast(np.array(gains(totals(counts), totals(aimed), buckets), np.int64))

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            bucket, count = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            size = pa.compute.list_value_length(batch.column(3)).to_numpy()
            ends = np.cumsum(size)
            whole, of = (np.r_[0, np.cumsum(x)] for x in (count * table.value[bucket], count))
            n = of[ends] - of[ends - size]
            weight = np.where(n > 0, (whole[ends] - whole[ends - size]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(weight)], ["key", "doc_id", "n_words", "n_features", "weight"])

    weighed = counts.where("key is not null").mapInArrow(weigh, "key long, doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + luck).withColumn("_late", F.col("n_words") < least_words).withColumn("_down", -F.col("score"))
    scored = scored.select("key", "doc_id", "n_features", "weight", "score", "_late", "_down", F.col("doc_id").isNull().alias("_last"))
    placed = ranked(scored, ["_late", "_down", "_last", "doc_id", "key"])
    drawn = scored.where("not _late").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when((F.col("rank") <= drawn) & ~F.col("_late"), F.col("rank")).alias("rank"))


SQL = f"""WITH byte AS (SELECT list_transform(range(256), lambda v: list_reduce([v] || range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END)) AS t),
 read AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS doc, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
 split AS (SELECT side, doc, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM read),
 word AS (SELECT side, doc, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM split),
 gram AS (SELECT side, doc, word AS gram FROM word UNION ALL
   SELECT side, doc, word || ' ' || next FROM (SELECT *, lead(word) OVER (PARTITION BY side, doc ORDER BY place) AS next FROM word) WHERE next IS NOT NULL),
 hashed AS (SELECT gram, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 2 * strlen(gram), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
     lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket
   FROM (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM gram)), byte),
 own AS (SELECT side, doc, bucket, count(*) AS n FROM gram JOIN hashed USING (gram) GROUP BY ALL),
 total AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM own GROUP BY bucket),
 gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM total) + 10000) / ((s + 1) * ((SELECT sum(t) FROM total) + 10000))))::BIGINT AS gain FROM total),
 weighed AS (SELECT doc, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n)::DOUBLE)::BIGINT AS weight FROM own JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc),
 scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, coalesce(n_words, 0) >= 20 AS drawable
   FROM read LEFT JOIN weighed USING (doc) LEFT JOIN (SELECT doc, count(*) AS n_words FROM word WHERE side = 0 GROUP BY doc) USING (doc) WHERE read.side = 0)
SELECT doc_id, n_features, weight, score, CASE WHEN drawable AND r <= (SELECT count(*) FROM scored WHERE drawable) * 25 // 100 THEN r END AS rank
FROM (SELECT *, row_number() OVER (ORDER BY drawable DESC, score DESC, doc_id) AS r FROM scored)"""
