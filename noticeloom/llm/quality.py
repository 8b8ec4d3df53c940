"""Quality of whole texts: supervised subword embeddings.

Every word, every character n-gram of " word " and every pair of neighbouring words has a learned
vector, by hash. A document is the average of its vectors; a linear layer and a softmax turn
it into a probability of each class. Vectors and layer are trained together by stochastic gradient descent in
numpy. As all is linear before the softmax, prediction adds up what each vector gives to each class.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import softmax
from .lexicon import Lexicon, Rows
from .shared import give_back, small_batches

#: Lengths of character n-grams, hashed vectors, and their width. They bound the model, whatever the corpus.
ORDERS, VECTORS, WIDTH = (3, 4, 5), 1 << 17, 10
#: The vector of a word that follows itself, whatever word it is; vector 0 belongs to no feature.
AGAIN = 1
#: Passes over the sample; steps of the layer and of the vectors, which fall to 0.
EPOCHS, LAYER_STEP, VECTOR_STEP = 5, 0.5, 10.0
#: Labelled rows that the fit takes of each class at most, in expectation, chosen by hash.
SAMPLE_PER_CLASS = 3000
#: From this score on a text counts as good.
THRESHOLD = 0.3

MIX = 0x9E3779B97F4A7C15


def _bucket(mixed):
    import numpy as np

    return ((mixed >> np.uint64(40)) % np.uint64(VECTORS - 2)).astype(np.int64) + 2


def word_vectors(words: list[str]):
    """Numbers of the vectors of words and their character n-grams, the word that each belongs to, and a hash a word."""
    import numpy as np

    code = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    own = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    mixed, found, owners = np.zeros(len(code), np.uint64), [_bucket(own * np.uint64(MIX))], [np.arange(len(words))]
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        mixed = (mixed[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint64(MIX)
        if n in ORDERS:
            one = owner[: len(mixed)] == owner[n - 1 :]
            found.append(_bucket(mixed[one]))
            owners.append(owner[: len(mixed)][one])
    return np.concatenate(found), np.concatenate(owners), own


def pair_vectors(own):
    """Numbers of the vectors of neighbouring words, from the words' hashes in order."""
    import numpy as np

    mixed = (own[:-1] * np.uint64(MIX) ^ own[1:]) * np.uint64(MIX)
    return np.where(own[:-1] == own[1:], AGAIN, _bucket(mixed))


def _split(text: str | None) -> list[str]:
    return (text or "").split()


class WordLexicon(Lexicon):
    """Keeps each word's vectors and hash."""

    def __init__(self):
        self.vectors: list = []
        self._clear()
        super().__init__(self._new, self._clear)

    def _clear(self) -> None:
        self.vectors.clear()
        self.own = Rows(1, "u8")

    def _new(self, words: list[str]) -> None:
        import numpy as np

        vector, owner, own = word_vectors(words)
        order = np.argsort(owner, kind="stable")
        self.vectors += np.split(vector[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])
        self.own.add(own[:, None])

    def averaged(self, ids):
        """A text's distinct vectors and their shares."""
        import numpy as np

        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        found, n = np.unique(np.concatenate([*(self.vectors[i] for i in ids.tolist()), pair_vectors(self.own.rows[ids, 0])]), return_counts=True)
        return found.astype(np.int32), (n / n.sum()).astype(np.float32)


def fit(rows: list[tuple], labels: list[int], classes: int, weights: list[float]):
    """`rows`: (vectors, shares). Stochastic gradient descent; the vectors, the layer and its constants.

    A class's errors weigh by `weights`, so that probabilities follow the corpus and not the sample.
    """
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (VECTORS, WIDTH)).astype(np.float32)
    layer, constant = np.zeros((classes, WIDTH), np.float32), np.zeros(classes, np.float32)
    order, step, steps = np.arange(len(rows)), 0, max(1, EPOCHS * len(rows))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in order.tolist():
            at, share = rows[k]
            own = vectors[at]
            hidden = share @ own
            error = softmax(layer @ hidden + constant)
            error[labels[k]] -= 1
            error *= weights[labels[k]] * (1 - step / steps)
            back = error @ layer
            layer -= LAYER_STEP * np.outer(error, hidden)
            constant -= LAYER_STEP * error
            vectors[at] = own - VECTOR_STEP * share[:, None] * back
            step += 1
    return vectors, layer, constant


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Learn from labelled rows: classes, vectors, layer, constant.

    The sample has SAMPLE_PER_CLASS rows of each class in expectation, chosen and ordered by hash, so its ids are a bounded
    broadcast, its averages meet in one task, and the fit is the same however rows lie. Null labels and ids are left out; an id labelled twice keeps
    the larger label. Without labels the one class is 1.
    """
    import numpy as np

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id_")).agg(F.max(F.col(label_col).cast("int")).alias("class"))
    counts = {r[0]: r[1] for r in known.groupBy("class").count().collect()}
    classes = sorted(counts) or [1]
    bare = {"classes": classes, "vectors": np.zeros((VECTORS, WIDTH), np.float32), "layer": np.zeros((len(classes), WIDTH), np.float32), "constant": np.zeros(len(classes), np.float32)}
    if len(classes) < 2:
        return bare
    chance = F.pmod(F.xxhash64("_id_", F.lit("quality")), F.lit(1_000_000)) / 1_000_000
    share, number = F.lit(0.0), F.lit(0)
    for k, c in enumerate(classes):
        share = F.when(F.col("class") == c, min(1.0, SAMPLE_PER_CLASS / counts[c])).otherwise(share)
        number = F.when(F.col("class") == c, k).otherwise(number)
    sample = known.where(chance < share).select("_id_", number.alias("label"))
    read = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("_id_"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "_id_")

    def averages(batches):
        import pyarrow as pa

        lexicon = WordLexicon()
        for batch in batches:
            rows = [lexicon.averaged(ids) for ids in lexicon.ids(batch.column(2).to_pylist(), _split)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))], ["place", "label", "at", "share"]
            )

    prior = np.array([counts[c] for c in classes], float) / sum(counts.values())

    def learn(batches):
        import pyarrow as pa

        rows, y = [], []
        for batch in batches:
            for label, at, share_ in zip(*(batch.column(i) for i in (1, 2, 3))):
                if len(at):
                    rows.append((at.values.to_numpy(), share_.values.to_numpy()))
                    y.append(label.as_py())
        taken = np.bincount(np.array(y, int), minlength=len(classes)) / max(1, len(y))
        found = fit(rows, y, len(classes), (prior / np.maximum(taken, 1e-9)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()]) for x in found], ["vectors", "layer", "constant"])

    place = F.xxhash64("_id_", F.lit("order")).alias("place")
    told = read.select(place, "label", "text").mapInArrow(averages, "place long, label int, at array<int>, share array<float>")
    model = told.repartition(1).sortWithinPartitions("place", "label", "at").mapInArrow(learn, "vectors binary, layer binary, constant binary").first()
    return {"classes": classes} | {k: np.frombuffer(model[k], "<f4").reshape(bare[k].shape) for k in ("vectors", "layer", "constant")}


def probabilities(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, name: str = "probabilities") -> DataFrame:
    """Columns `keep` (by default all) with an array `name`: a probability for each of the model's classes. One pass, no shuffle.

    Texts without words have the probabilities of the constants. A caller's column of the same name is an error, not lost.
    """
    import numpy as np
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    keep = keep or docs.columns
    if name in keep:
        raise ValueError(f"the table has a column {name}: give the result another name")
    taken = small_batches(docs).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(f"{name}_text"))
    classes, constant = len(model["classes"]), model["constant"]
    table = docs.sparkSession.sparkContext.broadcast((model["vectors"] @ model["layer"].T).astype(np.float32))
    schema = StructType(taken.schema.fields[:-1]).add(name, ArrayType(DoubleType()))
    names = schema.names

    def run(batches):
        import pyarrow as pa

        give_back()
        given = table.value
        sums, own = [Rows(classes + 1)], [Rows(1, "u8")]

        def new(words):
            vector, owner, hashes = word_vectors(words)
            gathered = given[vector]
            sums[0].add(np.stack([*(np.bincount(owner, gathered[:, c], len(words)) for c in range(classes)), np.bincount(owner, minlength=len(words))], 1))
            own[0].add(hashes[:, None])

        def reset():
            sums[0], own[0] = Rows(classes + 1), Rows(1, "u8")

        lexicon = Lexicon(new, reset)
        for batch in batches:
            logits = []
            for ids in lexicon.ids(batch.column(batch.num_columns - 1).to_pylist(), _split):
                if not len(ids):
                    logits.append(constant)
                    continue
                total = sums[0].rows[ids].sum(0)
                pairs = pair_vectors(own[0].rows[ids, 0])
                logits.append((total[:-1] + given[pairs].sum(0)) / (total[-1] + len(pairs)) + constant)
            p = softmax(np.array(logits, float).reshape(-1, classes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(p), pa.list_(pa.float64()))], names)

    return taken.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns `keep` (by default all) with the probability of class 1 and whether it reaches the threshold, under `names`.

    Null and empty texts have the score of the constants. Repeated rows score alike; an empty table gives no rows; a model that has not
    seen class 1 scores 0, one that has seen no other 1.
    """
    if clash := set(names) & set(keep or docs.columns):
        raise ValueError(f"the table has columns {sorted(clash)}: give the results other names")
    found = probabilities(docs, model, text_col, keep, "_probabilities_")
    p = F.element_at("_probabilities_", model["classes"].index(1) + 1) if 1 in model["classes"] else F.lit(0.0)
    return found.withColumn(names[0], p).withColumn(names[1], F.when(F.col(names[0]) >= threshold, 1).otherwise(0)).drop("_probabilities_")
