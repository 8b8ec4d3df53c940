"""Language model against brute force; held-out accuracy of classifiers; mixing against its targets."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeloom.llm import language_id, lm_scoring, mixing, toxicity

SYLLABLES = {"xx": ["ka", "lo", "mi", "ter", "un"], "yy": ["sch", "pfu", "gen", "ber", "ich"], "zz": ["eau", "que", "oire", "ment", "ais"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("order", [2, 3])
def test_lm_is_the_formula(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("A b c d e fé".split()) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "unseen b\x0bc d"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 4 != 1, order=order).collect()}
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    seqs = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\0"] for i, t in rows}
    counts = [Counter() for _ in range(order + 1)]
    for i, s in seqs.items():
        if i % 4 != 1:
            padded = ["\0"] * (order - 1) + s
            for k in range(len(s)):
                for n in range(1, order + 1):
                    counts[n][tuple(padded[k + order - n : k + order])] += 1
    total, words = sum(counts[1].values()), len(counts[1])
    discount = {n: min(0.95, max(0.1, sum(v == 1 for v in counts[n].values()) / max(1, sum(v == 1 for v in counts[n].values()) + 2 * sum(v == 2 for v in counts[n].values())))) for n in range(2, order + 1)}
    context = {n: Counter() for n in range(2, order + 1)}
    after = {n: Counter() for n in range(2, order + 1)}
    for n in range(2, order + 1):
        for g, v in counts[n].items():
            context[n][g[:-1]] += v
            after[n][g[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (counts[1][gram] + 0.5) / (total + 0.5 * (words + 1))
        n, h = len(gram), gram[:-1]
        if not context[n][h]:
            return p(gram[1:])
        return max(counts[n][gram] - discount[n], 0) / context[n][h] + discount[n] * after[n][h] / context[n][h] * p(gram[1:])

    for i, s in seqs.items():
        padded = ["\0"] * (order - 1) + s
        want = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(s)))
        base = sum(math.log10(p((w,))) for w in s)
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["base_score"] == pytest.approx(base, abs=1e-6)
        assert got[i]["n_tokens"] == len(s) and got[i]["n_known"] == sum(counts[1][(w,)] > 0 for w in s) and got[i]["train_tokens"] == total
    seen = [w for (w,) in counts[1]]
    for h in [("b",), ("\0",), ("never",)]:
        assert sum(p((*h, w)) for w in seen) + p((*h, "\1")) == pytest.approx(1.0, abs=1e-9)


def test_walk_backs_off_where_an_arc_lacks_and_pieces_are_the_whole():
    """States: 0 nothing, 1 after word 5, 2 after words 5 6. Words 5, 6 and 7 are known alone, 6 after 5, 7 after 5 6."""
    import numpy as np

    arcs = {(0, 5): (-1.0, 1), (0, 6): (-2.0, 0), (0, 7): (-3.0, 0), (1, 6): (-0.1, 2), (2, 7): (-0.2, 0)}
    model = lm_scoring.Automaton(
        np.array([s << 32 | w for s, w in arcs]), np.array([w for w, _ in arcs.values()]), np.array([n for _, n in arcs.values()]), np.array([0, 0, 0]), np.array([0.0, -0.5, -0.25]), -9.0, 0
    )
    tokens = np.array([5, 6, 7, 5, 7, 6, 5, 6, 6, 8, 5, 6, 7])
    want = [-1.0, -0.1, -0.2, -1.0, -0.5 - 3, -2.0, -1.0, -0.1, -0.25 - 2, -9.0, -1.0, -0.1, -0.2]
    for piece in (2, 3, 5, 256):
        assert model.walk(tokens, np.array([0, 3]), np.array([3, 10]), 2, piece).tolist() == pytest.approx(want)


def test_lm_long_and_repeated_texts(spark):
    rng = random.Random(4)
    long_ = " ".join(rng.choice("a b c d".split()) for _ in range(30_000))
    rows = [(1, long_, 0.0), (2, long_, 0.0), (2, long_, 0.0), (None, "a b", 0.0), (3, "a b", 0.0)]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string, score double"), F.lit(True)).collect()
    scores = {(r["doc_id"], round(r["score"], 6)) for r in got}
    assert len(got) == 5 and len(scores) == 4 and len({s for i, s in scores if i in (1, 2)}) == 1 and len({s for i, s in scores if i in (None, 3)}) == 1
    assert all(r["n_tokens"] == 30_001 for r in got if r["doc_id"] in (1, 2)) and all(r["score"] < 0 for r in got)


def test_words_are_cut_as_bytes_are():
    """Against Python's bytes, whose blanks are the same six; other scripts' blanks and letters stay."""
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["", None, " ", " A b ", "\u0130 \u212a", *("".join(rng.choice("aB \t\n\x0b\x0c\r\x1c\x1f\x00\u00a0\u0085\u3000\u00c9") for _ in range(rng.randint(0, 30))) for _ in range(1000))]
    words, each = lm_scoring._split(pa.array(["first", *texts], pa.string()).slice(1))
    want = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and each.tolist() == [len(ws) for ws in want]


def _shuffled(spark) -> int:
    """Bytes that all stages of the session have written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    jvm = spark._jvm
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lm_shards_stay_and_contexts_seen_once_ask_nothing(spark):
    """What travels are n-grams with their counts, once an order, and the totals; nearly all pairs of words occur once."""
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(20_000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=1000))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    before = _shuffled(spark)
    assert lm_scoring.score_texts(docs, F.col("doc_id") % 5 != 1).count() == 200
    assert (_shuffled(spark) - before) / 200_200 < 30  # 45 when shards travelled too
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("noticeloom_")]
    docs.unpersist()


def test_lm_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    r = lm_scoring.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(0.0)


def test_language_held_out(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, rng.choice([5, 40, 200])), lang, "clash", 1.0) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    df = spark.createDataFrame([*rows, (900, None, "xx", "c", 0.0), (901, " 12 !! ", None, "c", 0.0), (None, "kalo mi", None, None, None)], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(df.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    late = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, *_ in late) >= 0.97 * len(late)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] == "xx"
    none = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"} and language_id.predict(df.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words, bad = prose(rng, "xx", 60).split(), i % 4 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(["vrogga", "vrogger", "vroggum"]) + rng.choice("xyz")
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (700, None), (701, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    late = [(i, t) for i, t in labels if i % 5 == 0]
    assert sum(got[i]["predicted"] == t for i, t in late) >= 0.97 * len(late) and got[700]["predicted"] == got[701]["predicted"] == 0
    alone = toxicity.train(df, lab.limit(0))
    said = spark.createDataFrame([(1, "you are an idiot and scum."), (2, "a fine day."), (3, "she is not stupid.")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(said, alone).orderBy("doc_id").collect()] == [1, 0, 0]
    assert toxicity.score(df.limit(0), model).count() == 0
    same = spark.createDataFrame([(1, rows[0][1], "own"), (1, rows[0][1], "own"), (2, " ".join([rows[0][1]] * 800), None)], "doc_id long, text string, score string")
    told = toxicity.score(same, model, keep=["doc_id", "text"]).collect()
    assert len(told) == 3 and len({(r["doc_id"], r["score"]) for r in told}) == 2 and all(r["predicted"] == 1 for r in told)


def test_grammar_paths():
    import numpy as np

    lexicon = toxicity.WordCodes({"idiot": 2.0})

    def paths(text):
        (ids,) = lexicon.ids([text], toxicity.split_words)
        return dict(zip(toxicity.PATHS, toxicity.score_clauses(lexicon.codes.rows[ids])))

    assert paths("You idiot!")["targeted"] == 2.0 and paths("fine words.")["clauses"] == 0
    assert paths("he is not an idiot.")["negated"] == 2.0 and paths("not me. an idiot.")["plain"] == 2.0
    assert paths("she said: idiot")["plain"] == 2.0 and paths("she said idiot")["reported"] == 2.0 and paths("I kill you.")["threat"] == 1.0
    assert paths("I will not kill you.")["threat"] == 0 and paths("I will not kill you.")["negated"] == 1.0
    assert paths("she said I kill you.")["threat"] == 0 and paths("she said I kill you.")["reported"] == 1.0
    assert paths("not now. I kill you!")["threat"] == 1.0 and paths("I kill time.")["threat"] == 0
    assert paths("you a b idiot")["targeted"] == 2.0 and paths("you a b c idiot")["targeted"] == 0 and paths("idiot a b you")["targeted"] == 2.0 and paths("idiot a b c you")["targeted"] == 0
    assert paths("not a b idiot")["negated"] == 2.0 and paths("not a b c idiot")["negated"] == 0
    assert np.isfinite(list(paths("idiot " * 5000).values())).all()


def test_composition_is_its_parts():
    """Marks of the composed machine on random clauses, against each rule by brute force."""
    rng = random.Random(17)
    forwards, backwards = toxicity.grammar()
    assert len(forwards.then) == 4 * 2 * 4
    for _ in range(300):
        words = [rng.choice([0, 0, 0, 1, 2, 4, 8, 16, 5, 9, 31]) for _ in range(rng.randint(1, 14))]
        at = [k for k, w in enumerate(words) if w]
        ahead = toxicity.transduce(forwards, at, [words[k] for k in at])
        behind = toxicity.transduce(backwards, [-k for k in reversed(at)], [words[k] for k in reversed(at)])[::-1]
        for k, got in zip(at, (a | b for a, b in zip(ahead, behind))):
            near = lambda bit, lo, hi: any(w & bit for w in words[max(0, k - lo) : k + hi + 1])  # noqa: B023, E731
            want = (
                (words[k] & toxicity.INSULT and toxicity.INSULTING) | (words[k] & toxicity.THREAT and toxicity.THREATENING) | (near(toxicity.NEGATION, 3, 0) and toxicity.NEGATED)
                | (near(toxicity.REPORT, 99, 0) and toxicity.REPORTED) | (near(toxicity.TARGET, 3, 3) and toxicity.AIMED)
            )
            assert got == want


def test_mixing_meets_targets(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, "xx" if i % 3 else "yy", rng.choice([10, 50]))) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None), (None, "kalo"), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(0, 400, 2)] + [(3, None)], "doc_id long, domain string")
    got = mixing.mix(df, labels, {"a": 0.5, "b": 0.5}).collect()
    total = sum(r["tokens"] for r in got)
    for p in ("p_a", "p_b"):
        assert sum(r["rate"] * r["tokens"] * r[p] for r in got) / total == pytest.approx(0.5, abs=0.01)
    assert len(got) == 403 and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got)
    assert max(r["missed_by"] for r in got) < 0.01
    # A rate of 1.2 at most cannot lift a third to nine tenths, and the rows say so.
    held = mixing.mix(df, labels, {"a": 0.1, "b": 0.9}, most=1.2).collect()
    reached = sum(r["rate"] * r["tokens"] * r["p_b"] for r in held) / total
    assert max(r["rate"] for r in held) <= 1.2 and held[0]["missed_by"] >= 0.9 - reached - 1e-9 > 0.3
    assert mixing.mix(df.limit(0), labels).count() == 0 and {r["rate"] for r in mixing.mix(df, labels.limit(0), {}).collect()} == {1.0}


def test_language_model_knows_two_words_before(spark):
    """With bigrams alone "a b d" and "x b d" have one score."""
    texts = ["a b c"] * 6 + ["x b d"] * 6 + ["a b d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(df, F.col("doc_id") < 12).collect()}
    assert got[12] < got[11] - 0.1


def test_language_ties_repeats_and_long_texts(spark):
    """Two languages of the same texts tie: the first by name is told, alike for every equal row; a long text is read whole."""
    rng = random.Random(23)
    rows = [(i, prose(rng, "xx", 30), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(i + 1000, t, "bb" if lang == "aa" else "aa") for i, t, lang in rows]
    rows += [(5000 + i, prose(rng, "yy", 30), "cc") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    long_ = prose(rng, "xx", 10) + " " + prose(rng, "yy", 60_000)
    asked = spark.createDataFrame([(1, rows[0][1], 1), (1, rows[0][1], 2), (2, long_, 3), (3, rows[-1][1], 4)], "doc_id long, text string, tokens int")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(asked, model).collect()]
    assert len(got) == 4 and len(set(got)) == 3 and {p for i, p, _ in got if i == 1} <= {"aa", "bb"} and {p for i, p, _ in got if i in (2, 3)} == {"cc"}


def test_mixing_clashing_columns_repeats_and_long_texts(spark):
    rng = random.Random(29)
    rows = [(i, prose(rng, "xx" if i % 2 else "yy", 20), 1.0, 2, "p", 0.5) for i in range(120)]
    rows += [rows[0], (500, prose(rng, "xx", 50_000), None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate double, copies int, posterior string, tokens double")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b", 1) for i in range(120)], "doc_id long, domain string, text int")
    got = mixing.mix(df, labels, {"a": 0.9, "b": 0.1}).collect()
    assert len(got) == 122 and [r["tokens"] for r in got if r["doc_id"] == 500] == [50_000] and len({(r["rate"], r["copies"]) for r in got if r["doc_id"] == 0}) == 1


def _members(spark, rows, parts):
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(rows)], "doc_id long, tokens long, posterior array<double>").repartition(parts)


def test_mixing_is_least_squares_whatever_the_order(spark):
    """Against plain projected gradient steps, many of them, for targets that can and cannot be met."""
    import numpy as np

    rng = np.random.default_rng(4)
    for sharp, want in ((6.0, {"a": 0.6, "b": 0.3, "c": 0.1}), (1.0, {"a": 0.5, "b": 0.2, "c": 0.3}), (0.3, {"a": 0.98, "b": 0.01, "c": 0.01})):
        p = rng.dirichlet(np.ones(3) / sharp, 60)
        tokens = rng.integers(0, 300, 60)
        rows = [(int(n), [float(x) for x in q]) for n, q in zip(tokens, p)]
        one, seven = (mixing.fit_rates(_members(spark, rows, n), ["a", "b", "c"], want) for n in (1, 7))
        assert one == seven
        rate, goal, t = np.ones(60), np.array(list(want.values())), tokens / tokens.sum()
        for _ in range(40_000):
            rate = np.maximum(0, rate - 0.9 * p @ ((t * rate) @ p - goal) / ((t * p.T) @ p).trace() * 1)
        reached = np.abs((t * rate) @ p - goal).max()
        missed = max(abs(a - b) for a, b in zip(one[1], one[2]))
        assert missed <= reached + 0.01


def test_mixing_does_not_depend_on_how_rows_lie(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, "xx" if i % 2 else "yy", 40)) for i in range(80)]
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(60)], "doc_id long, domain string")
    got = [sorted(tuple(r) for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels, {"a": 0.8, "b": 0.2}).collect()) for n in (1, 7)]
    assert [(r[0], r[1]) for r in got[0]] == [(r[0], r[1]) for r in got[1]]
    assert all(x == pytest.approx(y, abs=1e-9) for a, b in zip(*got) for x, y in zip(a, b))
    assert got[0][0][5] < 0.01
