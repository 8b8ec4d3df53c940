"""Mixing by soft membership: document rates whose expected domain tokens match targets.

A classifier fitted on the labelled table gives every document a posterior over domains.
Projected-gradient least squares then finds a nonnegative rate for each document, so that
rate x tokens x posterior sums to each domain's target. What a target is missed by is told.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .lexicon import Lexicon, Rows
from .shared import give_back, small_batches, staged

COLUMNS = 1 << 16
SCALE = 20.0
#: An odd multiplier that mixes hashes.
MIX = 0x9E3779B97F4A7C15
#: Labelled rows that the fit takes of each domain at most, in expectation, chosen by hash.
SAMPLE_PER_DOMAIN = 2500
#: The solver ends when its slope is this flat, or when no step, however short, goes down. RIDGE keeps it finite where targets cannot be met.
TOLERANCE, SHORTEST, RIDGE = 1e-5, 2.0**-20, 1e-7
#: Production targets: shares of all tokens by domain (quality and toxicity labels).
TARGETS = {"q1_t0": 0.90, "q0_t0": 0.07, "q1_t1": 0.03}


def domain_of(labels: DataFrame) -> Column:
    """The domain of a labelled row; null if either label is."""
    return F.concat(F.lit("q"), labels["quality"].cast("int"), F.lit("_t"), labels["toxic"].cast("int"))


def word_features(words: list[str]):
    """Three hashed features a word: itself in lower case, its first five letters, its shape."""
    import numpy as np

    if not words:
        return np.zeros((0, 3), np.int64)
    lower = list(map(str.lower, words))
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, lower), np.int64, len(lower))  # words have a letter at least
    start = np.cumsum(size) - size
    place = np.arange(len(code)) - np.repeat(start, size)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max()), np.uint64(MIX))])
    part = code * power[place]
    whole = np.add.reduceat(part, start)
    first = np.add.reduceat(np.where(place < 5, part, np.uint64(0)), start)
    # How a word is written, and its last two letters where it is not of letters and digits alone.
    style = np.array([w.isupper() * 2 + w[0].isupper() for w in words], np.uint64)
    end = start + size - 1
    marks = np.where(np.fromiter((not w.isalnum() for w in words), bool, len(words)), code[end] * np.uint64(MIX) + np.where(size > 1, code[np.maximum(end - 1, 0)], np.uint64(0)), np.uint64(0))
    mixed = np.stack([whole, first + np.uint64(7), marks * np.uint64(4) + style + np.uint64(3)], 1) * np.uint64(MIX)
    return ((mixed >> np.uint64(33)) % np.uint64(COLUMNS - 1)).astype(np.int64) + 1


def _split(text: str | None) -> list[str]:
    return (text or "").split()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Multinomial logistic regression of labels' `domain` on hashed words, on a bounded sample.

    `labels` has the id and `domain`; null domains are left out, of several the least counts.
    The sample's ids are a bounded broadcast; its vectors meet in one task, in an
    order of their ids' hashes, so the fit does not depend on how rows lie.
    """
    import numpy as np

    known = labels.where(F.col("domain").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id_")).agg(F.min("domain").alias("domain"))
    counts = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    domains = sorted(counts)
    if not domains:
        return {"domains": ["all"], "weights": np.zeros((1, COLUMNS))}
    share, number = F.lit(0.0), F.lit(0)
    for k, d in enumerate(domains):
        share = F.when(F.col("domain") == d, min(1.0, SAMPLE_PER_DOMAIN / counts[d])).otherwise(share)
        number = F.when(F.col("domain") == d, k).otherwise(number)
    chance = F.pmod(F.xxhash64("_id_", F.lit("mixing")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(chance < share).select("_id_", number.alias("label"))
    read = small_batches(docs).select(F.col(id_col).cast("long").alias("_id_"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id_").select(F.xxhash64("_id_", F.lit("order")).alias("place"), "label", "text")

    def vectors(batches):
        import pyarrow as pa

        kept = [Rows(3, "i8")]
        lexicon = Lexicon(lambda w: kept[0].add(word_features(w)), lambda: kept.__setitem__(0, Rows(3, "i8")))
        for batch in batches:
            at, x = [], []
            for ids in lexicon.ids(batch.column(2).to_pylist(), _split):
                f, n = np.unique(kept[0].rows[ids].ravel(), return_counts=True)
                at.append(f.astype(np.int32))
                x.append((n / max(1, len(ids)) * SCALE).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["place", "label", "at", "x"])

    prior = np.array([counts[d] for d in domains], float) / sum(counts.values())

    def learn(batches):
        import pyarrow as pa

        rows, y = [], []
        for batch in batches:
            for label, at, x in zip(*(batch.column(i) for i in (1, 2, 3))):
                rows.append((np.append(0, at.values.to_numpy()), np.append(1.0, x.values.to_numpy().astype(float))))
                y.append(label.as_py())
        taken = np.bincount(np.array(y, int), minlength=len(domains)) / max(1, len(y))
        weights = (prior / np.maximum(taken, 1e-9)).tolist()
        w = ftrl.fit(rows, y, len(domains), COLUMNS, weights=weights, epochs=2)
        c, f = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(f), pa.array(w[c, f])], ["class", "feature", "weight"])

    model = read.mapInArrow(vectors, "place long, label int, at array<int>, x array<float>").repartition(1).sortWithinPartitions("place", "label", "at").mapInArrow(learn, "class long, feature long, weight double").toPandas()
    weights = np.zeros((len(domains), COLUMNS))
    weights[model["class"], model["feature"]] = model["weight"]
    return {"domains": domains, "weights": weights}


def memberships(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens (white-space words of the whole text), posterior array over the domains."""
    import numpy as np

    k = len(model["domains"])
    table = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model["weights"].T))

    def run(batches):
        import pyarrow as pa

        give_back()
        sums = [Rows(k)]
        lexicon = Lexicon(lambda w: sums[0].add(table.value[word_features(w)].sum(1)), lambda: sums.__setitem__(0, Rows(k)))
        constant = table.value[0]
        for batch in batches:
            tokens, logits = [], []
            for ids in lexicon.ids(batch.column(1).to_pylist(), _split):
                tokens.append(len(ids))
                logits.append(sums[0].rows[ids].sum(0) / max(1, len(ids)) * SCALE + constant)
            p = ftrl.softmax(np.array(logits).reshape(-1, k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "tokens", "posterior"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def _unbound(prices: list[float]) -> Column:
    """1 and all steps so far, before the projection: steps add up to one number a domain."""
    return functools.reduce(lambda x, iv: x + F.lit(float(iv[1])) * F.element_at("posterior", iv[0] + 1), enumerate(prices), F.lit(1.0))


def _rate(prices: list[float], most: float | None) -> Column:
    """The rate: from 1 down all slopes, and then projected into its bounds."""
    down = F.greatest(F.lit(0.0), _unbound(prices))
    return down if most is None else F.least(F.lit(float(most)), down)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], most: float | None = None) -> tuple[list[float], list[float], list[float]]:
    """Projected-gradient least squares on domain totals; returns the sum of all steps, the shares that they reach, and the targets as shares.

    The projection comes after the sum of the steps, so what is kept is one number a domain, and rates are the nearest to 1 that meet the
    targets. A step is the slope scaled by the domains' Gram matrix over the documents within their bounds, and halved until
    it goes down. A try sums one value a domain and one a pair of domains over all documents. There is no limit
    of steps: the problem is strictly convex, so it ends at its one solution, at the least squares where targets cannot be met.
    """
    import numpy as np

    k = len(domains)
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    want = want / want.sum() if want.sum() else np.full(k, 1 / k)
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = members.agg(F.sum("tokens")).first()[0]
    if not total:
        return [0.0] * k, want.tolist(), want.tolist()
    # Sums of whole numbers do not depend on how rows lie.
    whole = lambda x: F.sum(F.round(F.col("tokens") * x * 1e6).cast("decimal(38,0)"))

    def tried(prices):
        """What the prices cost, the shares of the domains, and their Gram matrix over the documents within their bounds."""
        rate, own = _rate(prices.tolist(), most), _unbound(prices.tolist())
        within = (own > 0) & (F.lit(True) if most is None else own < most)
        sums = members.select("tokens", "posterior", rate.alias("rate"), own.alias("own"), within.alias("within")).agg(
            whole(F.col("rate") * F.col("own") - F.col("rate") * F.col("rate") / 2).alias("cost"), *(whole(F.col("rate") * x).alias(f"s{i}") for i, x in enumerate(p)),
            *(whole(F.when(F.col("within"), p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i, j in pairs),
        ).first()
        cost, *rest = [float(x) / 1e6 / total for x in sums]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, rest[k:]):
            gram[i, j] = gram[j, i] = x
        return cost - prices @ want + RIDGE / 2 * prices @ prices, np.array(rest[:k]), gram

    prices = np.zeros(k)
    cost, got, gram = tried(prices)
    while True:
        slope = got - want + RIDGE * prices
        if np.abs(slope).max() < TOLERANCE:
            break
        step, length = -np.linalg.solve(gram + RIDGE * np.eye(k), slope), 1.0
        while length >= SHORTEST:
            told = tried(prices + length * step)
            if told[0] <= cost + 1e-4 * length * (slope @ step):
                break
            length /= 2
        else:
            break
        prices = prices + length * step
        cost, got, gram = told
    return prices.tolist(), got.tolist(), want.tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", most: float | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, tokens, posterior by domain, rate, copies, missed_by.

    `missed_by` is the same on all rows: the most by which a domain's share of all tokens misses its target, 0 or
    nearly 0 where the targets can be met. With `most` no rate is larger, which may add to it.
    `copies` is the rate rounded up or down by a hash of the id, so its mean is the rate.
    Null and empty texts have no tokens and the prior-like posterior of no words; without
    labels there is one domain and every rate is 1. Ids may repeat or be null; labels of
    unknown ids are ignored, extra columns too. An empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    members = staged(memberships(docs, model, id_col, text_col), "memberships")
    prices, got, want = fit_rates(members, model["domains"], targets or TARGETS, most)
    missed = max(abs(a - b) for a, b in zip(got, want))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    return members.select(
        "doc_id", "tokens", *(F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(model["domains"])),
        _rate(prices, most).alias("rate"), F.lit(missed).alias("missed_by"),
    ).withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
