"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers, tables of states and arcs, read a clause's words: one marks insults, one
threats, one the words that a negation reaches, one those after a report, and two those near a
target, of which one reads backwards. They are composed once, and the composition walks each
clause once each way; the marks that a word gets from all of them tell the path on which its
weight counts. What a text's clauses weigh, by kind of path, is summed; a logistic layer fitted on
labelled rows turns the sums into a probability. The insults' words and word beginnings, and
their weights, are learned from labelled rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import Lexicon, Rows
from .shared import give_back, small_batches

# The words that each transducer accepts beside what labels teach.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb garbage imbecile idiota estúpido imbécil basura idiot dumm abschaum müll versager connard crétin ordure minable".split()
THREATS = "kill hurt destroy beat smash die burn matar destruir morir töten zerstören sterben tuer détruire mourir".split()
TARGETS = "you your yours u they them their he she him her these those tú usted vosotros ellos du ihr sie euch dich tu vous toi ils elles".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie jamás nunca pas jamais".split()
REPORTS = "said says wrote called claimed quoted reported alleged according dijo según sagte schrieb laut dit écrit selon".split()

#: Letters that a learned word beginning has.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows that learning takes of each class at most, in expectation, chosen by hash.
SAMPLE_PER_CLASS = 6000
#: Rows of both classes that a learned pattern needs, its least log odds, and the patterns kept.
SUPPORT, ODDS, PATTERNS = 6, 2.5, 20_000
#: Kinds of paths that the logistic layer weighs, after its constant.
PATHS = ("plain", "targeted", "negated", "reported", "threat", "clauses", "heaviest")
#: Working columns.
SCORED, PATH_SUMS = "_noticeloom_scored_", "_noticeloom_paths_"
#: Words after a negation that it turns, and words on either side at which a target is near.
NEGATION_REACH, NEAR = 3, 3
#: Kinds of words, as bits of the symbol that transducers read; a word may be of several.
INSULT, THREAT, TARGET, NEGATION, REPORT = (1 << k for k in range(5))
SYMBOLS = 1 << 5
#: Marks that transducers write.
INSULTING, THREATENING, NEGATED, REPORTED, AIMED = (1 << k for k in range(5))
EDGE = "\"'()[]{}<>|*_~`.,;:!?…«»“”‘’-–—"
ENDS = (".", "!", "?", ";", ":", "…")


def patterns_of(word: str) -> set[str]:
    """The patterns that accept a word: itself, and its beginnings marked with a star."""
    return {word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)}


def split_words(text: str | None) -> list[str]:
    """Whole text, lower case; white space parts words, punctuation stays for the clause ends."""
    return (text or "").lower().split()


@dataclass(frozen=True)
class Transducer:
    """`then[state, symbol]` is the next state and `marks[state, symbol]` what the arc writes, as bits. State 0 begins a clause."""

    then: object
    marks: object

    def composed(self, other: Transducer) -> Transducer:
        """Both side by side on the same words: states are pairs, marks are those of either."""
        import numpy as np

        n, m = len(self.then), len(other.then)
        then = self.then[:, None] * m + other.then[None]
        return Transducer(then.reshape(n * m, SYMBOLS), np.bitwise_or(self.marks[:, None], other.marks[None]).reshape(n * m, SYMBOLS))


def marking(kind: int, mark: int) -> Transducer:
    """Marks words of a kind."""
    import numpy as np

    symbols = np.arange(SYMBOLS)
    return Transducer(np.zeros((1, SYMBOLS), np.int64), np.where(symbols & kind, mark, 0)[None])


def reaching(kind: int, mark: int, reach: int | None) -> Transducer:
    """Marks words of a kind and the `reach` words after each, or all after it. The state is how many are still to be marked."""
    import numpy as np

    symbols, most = np.arange(SYMBOLS), reach or 1
    states = np.arange(most + 1)[:, None]
    passed = np.maximum(states - 1, 0) if reach else states
    hit = (symbols & kind) > 0
    return Transducer(np.where(hit, most, passed), np.where(hit | (states > 0), mark, 0))


@functools.cache
def grammar() -> tuple[Transducer, Transducer]:
    """The composition that reads a clause forwards, and the one that reads it backwards, as lists."""
    parts = [marking(INSULT, INSULTING), marking(THREAT, THREATENING), reaching(NEGATION, NEGATED, NEGATION_REACH), reaching(REPORT, REPORTED, None), reaching(TARGET, AIMED, NEAR)]
    listed = lambda t: Transducer(t.then.tolist(), t.marks.tolist())
    return listed(functools.reduce(Transducer.composed, parts)), listed(reaching(TARGET, AIMED, NEAR))


def transduce(machine: Transducer, places: list[int], symbols: list[int]) -> list[int]:
    """Marks of the telling words of a clause, which stand at `places`; the words between are of no kind (symbol 0)."""
    then, marks = machine.then, machine.marks
    state, before, out = 0, None, []
    for place, symbol in zip(places, symbols):
        # Reaches are short: after so many plain words the state stands still.
        for _ in range(min(place - before - 1, max(NEGATION_REACH, NEAR)) if before is not None else 0):
            state = then[state][0]
        out.append(marks[state][symbol])
        state, before = then[state][symbol], place
    return out


class WordCodes(Lexicon):
    """Per word: insult weight, symbol, clause end."""

    def __init__(self, insults: dict[str, float]):
        import numpy as np

        kinds = [(THREAT, frozenset(THREATS)), (TARGET, frozenset(TARGETS)), (NEGATION, frozenset(NEGATIONS)), (REPORT, frozenset(REPORTS))]
        self.codes = Rows(3)

        def code(word: str) -> list[float]:
            bare = word.strip(EDGE)
            weight = max((insults.get(p, 0.0) for p in patterns_of(bare)), default=0.0) if bare else 0.0
            return [weight, float((weight > 0) * INSULT + sum(k for k, words in kinds if bare in words)), float(word.endswith(ENDS))]

        def new(words):
            self.codes.add(np.array([code(w) for w in words]).reshape(-1, 3))

        def reset():
            self.codes = Rows(3)

        super().__init__(new, reset)


def score_clauses(codes) -> list[float]:
    """Walk a text's clauses with the composed transducers; the sums of PATHS.

    An insult weighs its learned weight, a threat near a target weighs 1. What a negation reaches counts as negated, what follows
    a report as reported, all else as plain or threat, and as targeted near a target.
    """
    import numpy as np

    out = dict.fromkeys(PATHS, 0.0)
    symbols = codes[:, 1].astype(np.int64)
    hits = np.flatnonzero(symbols & (INSULT | THREAT))
    if not len(hits):
        return [0.0] * len(PATHS)
    forwards, backwards = grammar()
    ends = np.flatnonzero(codes[:, 2])
    for clause in np.unique(np.searchsorted(ends, hits)).tolist():
        first = int(ends[clause - 1]) + 1 if clause else 0
        last = int(ends[clause]) + 1 if clause < len(ends) else len(codes)
        places = np.flatnonzero(symbols[first:last])
        own, at = symbols[first + places].tolist(), places.tolist()
        ahead = transduce(forwards, at, own)
        behind = transduce(backwards, [-p for p in reversed(at)], own[::-1])[::-1]
        weight = 0.0
        for place, mark in zip(at, (a | b for a, b in zip(ahead, behind))):
            threat = 1.0 if mark & THREATENING and mark & AIMED else 0.0
            insult = float(codes[first + place, 0]) if mark & INSULTING else 0.0
            if mark & (NEGATED | REPORTED):
                out["negated" if mark & NEGATED else "reported"] += insult + threat
                continue
            out["plain"] += insult
            out["threat"] += threat
            weight += insult
            if mark & AIMED:
                out["targeted"] += insult
        out["clauses"] += weight > 0
        out["heaviest"] = max(out["heaviest"], weight)
    return [float(out[p]) for p in PATHS]


def _path_features(docs: DataFrame, insults: dict[str, float], text_col: str) -> DataFrame:
    """`docs` with an array column of path sums. One pass, no shuffle."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    taken, at = small_batches(docs), docs.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(insults)

    def run(batches):
        import pyarrow as pa

        give_back()
        lexicon = WordCodes(model.value)
        for batch in batches:
            rows = [score_clauses(lexicon.codes.rows[ids]) for ids in lexicon.ids(batch.column(at).to_pylist(), split_words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, PATH_SUMS])

    return taken.mapInArrow(run, StructType([*taken.schema.fields]).add(PATH_SUMS, ArrayType(DoubleType())))


def _pattern_counts(sample: DataFrame) -> DataFrame:
    """pattern, toxic and all rows of the sample whose text a pattern accepts."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        bad, good = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.strip(EDGE) for w in split_words(text)}
                words.discard("")
                (bad if toxic else good).update(set().union(*map(patterns_of, words)))
        names = list(bad)  # a pattern without toxic rows here adds only to the clean count
        names += [p for p in good if p not in bad]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[p] for p in names], pa.int64()), pa.array([good[p] for p in names], pa.int64())], ["pattern", "toxic", "clean"])

    counted = sample.select("toxic", "text").mapInArrow(run, "pattern string, toxic long, clean long")
    return counted.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Learn insult patterns and the logistic layer from labelled rows.

    The sample has SAMPLE_PER_CLASS rows of each class in expectation, chosen by hash, so
    its ids are a bounded broadcast and texts are not shuffled. Patterns of one half score the
    other, on which the layer is fitted; then the whole sample teaches the patterns. Labels that are null, and ids labelled twice, keep the larger label.
    Without both classes the fixed words alone decide.
    """
    import numpy as np

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id_")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    total, bad = sum(counts.values()), counts.get(1, 0)
    insults = {w: ODDS for w in INSULTS}
    if not bad or bad == total:
        return {"insults": insults, "layer": np.array([-2.5, 1.0, 0.5, 0.0, 0.0, 2.0, 0.5, 0.5])}
    chance = F.pmod(F.xxhash64("_id_", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(chance < F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_CLASS / bad)).otherwise(min(1.0, SAMPLE_PER_CLASS / (total - bad))))
    sample = sample.withColumn("late", F.pmod(F.xxhash64("_id_", F.lit("late")), F.lit(2)) == 1)
    read = small_batches(docs).select(F.col(id_col).cast("long").alias("_id_"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id_")
    early = insults | _learned(read.where("not late"))
    fitted = _path_features(read.where("late").select("toxic", "text"), early, "text").select("toxic", PATH_SUMS).toPandas()
    layer = fit_layer(np.array(fitted[PATH_SUMS].tolist()).reshape(-1, len(PATHS)), fitted["toxic"].to_numpy(), bad / total)
    return {"insults": insults | _learned(read), "layer": layer}


def _learned(sample: DataFrame) -> dict[str, float]:
    """Patterns with enough toxic rows and log odds, at most PATTERNS of them."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    found = _pattern_counts(sample).where(F.col("toxic") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= ODDS)
    return {r["pattern"]: r["odds"] for r in found.orderBy(F.desc("odds"), "pattern").limit(PATTERNS).collect()}


def squash(paths):
    """Path sums on a scale that grows slowly, with a constant in front."""
    import numpy as np

    return np.concatenate([np.ones((len(paths), 1)), np.log1p(np.maximum(paths, 0))], 1)


def fit_layer(paths, toxic, share: float):
    """Logistic regression by Newton steps with a ridge; rows weigh so that classes have their corpus share."""
    import numpy as np

    x, y = squash(paths), toxic.astype(float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) if len(y) else np.ones(0)
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, 0.3)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns `keep` (by default all) with the score (0 to 1) and what it predicts (1 from 0.5), under `names`.

    Null and empty texts have the score of a text without a matched clause. One pass, no
    shuffle; repeated rows score alike; extra columns stay as they are, but for ones that have
    the `names` of results: give other names to keep them.
    """
    keep = [c for c in keep or docs.columns if c not in names]
    taken = docs.select(*(F.col(f"`{c}`") for c in keep if c != text_col), F.col(f"`{text_col}`").alias(SCORED))
    layer = [float(x) for x in model["layer"]]
    logit = F.lit(layer[0])
    for k, w in enumerate(layer[1:]):
        logit = logit + w * F.log1p(F.greatest(F.element_at(PATH_SUMS, k + 1), F.lit(0.0)))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    found = _path_features(taken, model["insults"], SCORED).withColumn(names[0], p).withColumnRenamed(SCORED, text_col)
    return found.select(*(f"`{c}`" for c in keep), names[0], F.when(F.col(names[0]) >= 0.5, 1).otherwise(0).alias(names[1]))
