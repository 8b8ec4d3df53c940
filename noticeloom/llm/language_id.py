"""Language of whole texts: multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1- to 4-grams of lower-cased words between blanks, hashed to a
fixed number of columns; a text's vector is TF-IDF scaled to a sum of SCALE. Document
frequencies come from every learning row; only the fit itself takes a bounded sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .lexicon import Lexicon, Rows
from .shared import give_back, small_batches

ORDERS = (1, 2, 3, 4)
#: Columns of hashed n-grams: bounds the statistics and the model, whatever the corpus.
COLUMNS = 1 << 17
SCALE = 50.0
#: Rows that the fit takes of each language at most, and of all languages together, in expectation, chosen by hash.
SAMPLE_PER_LANGUAGE, SAMPLE = 1500, 60_000
UNDETERMINED = "und"


def word_grams(words: list[str]):
    """Hashed n-grams of " word ": feature numbers (from 1), and the word that each belongs to."""
    import numpy as np

    code = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    mixed, found, owners = np.zeros(len(code), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        mixed = (mixed[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            one = owner[: len(mixed)] == owner[n - 1 :]
            found.append(((mixed[one] >> np.uint64(40)) % np.uint64(COLUMNS - 1)).astype(np.int64) + 1)
            owners.append(owner[: len(mixed)][one])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


class GramLexicon(Lexicon):
    """Keeps each word's features."""

    def __init__(self):
        self.grams: list = []
        super().__init__(self._new, self.grams.clear)

    def _new(self, words: list[str]) -> None:
        import numpy as np

        feature, owner = word_grams(words)
        order = np.argsort(owner, kind="stable")
        self.grams += np.split(feature[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """feature, df over all rows of `docs`, plus feature 0 with the number of rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        give_back()
        lexicon, df, mark = GramLexicon(), np.zeros(COLUMNS, np.int64), np.zeros(COLUMNS, bool)
        for batch in batches:
            for ids in lexicon.ids(batch.column(0).to_pylist(), _words):
                df[0] += 1
                if len(ids):
                    mark[np.concatenate([lexicon.grams[i] for i in set(ids.tolist())])] = True
                    found = np.flatnonzero(mark)
                    df[found] += 1
                    mark[found] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])

    return docs.select(text_col).mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit on the rows of `docs` with a language: languages, weights, idf and temperature.

    The sample that the fit takes has SAMPLE_PER_LANGUAGE rows of each language in
    expectation, and no more than SAMPLE in all; a fifth of it calibrates the temperature. Sparse vectors of the sample
    meet in one task, and only the model, bounded by COLUMNS, comes to the driver.
    """
    import numpy as np

    known = small_batches(docs).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "weights": None, "temperature": 1.0}
    df = np.zeros(COLUMNS)
    for at, n in document_frequencies(known, text_col).collect():
        df[at] = n
    idf = np.log((1 + df[0]) / (1 + df)) + 1
    share, each = F.lit(0.0), min(SAMPLE_PER_LANGUAGE, SAMPLE / max(1, len(languages)))
    for lang in languages:
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, each / counts[lang]))).otherwise(share)
    chance = (F.xxhash64(F.col(id_col), F.lit("language")) % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    number = F.array_position(F.array(*map(F.lit, languages)), F.col(lang_col)).cast("int") - 1
    sample = known.where(chance < share).select(number.alias("label"), F.col(text_col).alias("text"), (F.xxhash64(F.col(id_col), F.lit("held")) % 5 == 0).alias("held"))

    def vectors(batches):
        import pyarrow as pa

        lexicon = GramLexicon()
        for batch in batches:
            at, x = [], []
            for ids in lexicon.ids(batch.column(1).to_pylist(), _words):
                feature, n = np.unique(np.concatenate([lexicon.grams[i] for i in ids.tolist()]) if len(ids) else np.zeros(0, np.int32), return_counts=True)
                v = n * idf[feature]
                at.append(feature.astype(np.int32))
                x.append((v / max(v.sum(), 1e-9) * SCALE).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["label", "held", "at", "x"])

    def learn(batches):
        import pyarrow as pa

        rows, labels, held = [], [], []
        for batch in batches:
            for label, late, at, x in zip(*(batch.column(i) for i in range(4))):
                at, x = at.values.to_numpy(), x.values.to_numpy().astype(float)
                rows.append((np.append(0, at), np.append(1.0, x)))
                labels.append(label.as_py())
                held.append(bool(late.as_py()))
        fitted = [k for k in range(len(rows)) if not held[k]] or list(range(len(rows)))
        w = ftrl.fit([rows[k] for k in fitted], [labels[k] for k in fitted], len(languages), COLUMNS)
        late = [k for k in range(len(rows)) if held[k]]
        logits = np.array([w[:, rows[k][0]] @ rows[k][1] for k in late]).reshape(-1, len(languages))
        c, f = np.nonzero(w)
        c, f, v = np.append(c, -1), np.append(f, 0), np.append(w[c, f], ftrl.temperature(logits, np.array([labels[k] for k in late], int)))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(f), pa.array(v)], ["class", "feature", "weight"])

    model = sample.mapInArrow(vectors, "label int, held boolean, at array<int>, x array<float>").repartition(1).mapInArrow(learn, "class long, feature long, weight double").toPandas()
    weights = np.zeros((len(languages), COLUMNS))
    known_rows = model[model["class"] >= 0]
    weights[known_rows["class"], known_rows["feature"]] = known_rows["weight"]
    return {"languages": languages, "weights": weights, "idf": idf, "temperature": float(model.loc[model["class"] < 0, "weight"].iloc[0])}


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns `keep` (by default all) of every row, with the language and its score (0 to 1), under `names`.

    Texts that are null or have no letter, and any text under a model without languages,
    are `und` with score 0. One pass, no shuffle; extra columns stay as they are, but for ones
    that have the `names` of results: give other names to keep them.
    """
    import numpy as np

    keep = [c for c in keep or docs.columns if c not in names]
    taken = small_batches(docs).select(*(F.col(f"`{c}`") for c in keep if c != text_col), F.col(f"`{text_col}`").alias("_noticeloom_text_"))
    languages, heat, text_kept = model["languages"], model["temperature"], text_col in keep
    if languages:
        table = np.concatenate([model["weights"] * model["idf"] * SCALE, model["idf"][None]]).T.astype(np.float32)
        constant = model["weights"][:, 0]
        used = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        give_back()
        sums, letter = [Rows(len(languages) + 1)], [Rows(1, bool)]

        def new(words):
            feature, owner = word_grams(words)
            gathered = used.value[feature]
            sums[0].add(np.stack([np.bincount(owner, gathered[:, c], len(words)) for c in range(gathered.shape[1])], 1))
            letter[0].add(np.array([[any(map(str.isalpha, w))] for w in words]))

        def reset():
            sums[0], letter[0] = Rows(len(languages) + 1), Rows(1, bool)

        lexicon = Lexicon(new, reset)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pred, score = [], []
            for ids in lexicon.ids(texts, _words) if languages else [[]] * len(texts):
                if not len(ids) or not letter[0].rows[ids, 0].any():
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                total = sums[0].rows[ids].sum(0)
                p = ftrl.softmax((total[:-1] / total[-1] + constant) / heat)
                pred.append(languages[best := int(p.argmax())])
                score.append(float(p[best]))
            kept = batch.columns if text_kept else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema_names)

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(taken.schema.fields[:] if text_kept else taken.schema.fields[:-1]).add(names[0], StringType()).add(names[1], DoubleType())
    schema_names = schema.names
    found = taken.mapInArrow(run, schema)
    return found.withColumnRenamed("_noticeloom_text_", text_col).select(*(f"`{c}`" for c in keep), *names)
