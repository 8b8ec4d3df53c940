"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from noticeloom.llm.queries import ORACLES, QUERIES


def test_stages_and_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(3)) for _ in range(900)]
    text = lambda: " ".join(rng.choice(words) for _ in range(80)) + "."
    docs = [(i, text(), "xx", "s", 0) for i in range(120)]
    docs[10] = (10, docs[3][1], "xx", "s", 0)
    docs[11] = (11, docs[3][1] + " kalomi", "xx", "s", 0)
    bad = range(60, 100)
    for i in bad:
        docs[i] = (i, docs[i][1] + " you are a moron and an idiot.", "xx", "s", 0)
    docs += [(200, "123 456", "xx", "s", 0), (201, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 2 == 0), int(i in bad)) for i in range(0, 120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r["doc_id"] for r in at.collect()})
    clean = set(range(120)) - set(bad)
    assert not kept[0] & set(bad) and clean <= kept[0]
    assert clean <= kept[1] and not kept[1] & {200, 201}
    assert kept[2] == kept[1] - {10, 11} and kept[3] <= kept[2]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == kept[3] and all(r["offset"] + r["length"] <= 2048 for r in rows)


def test_an_id_on_two_texts_loses_only_the_copy(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(60)) for k in "xyz")
    rows = [(3, x), (5, x), (5, y), (6, y + " more"), (7, z), (7, z + " more"), (None, x), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len([r for r in got if r[0] == 7]) == 1
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted([(3, x), (5, y), (None, x), (8, None)], key=str)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like results, empty tables and very long texts go through every stage."""
    rng = random.Random(2)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    shape = "doc_id long, text string, lang string, score double, predicted string, paths int, lang_pred string, copies int, `rate x` int, noticeloom string"
    rows = [(i, text(60 if i else 50_000), "xx", i / 7, "p", i, "l", 3, 4, "n") for i in range(40)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, shape)
        kept = {r["doc_id"]: tuple(r) for r in docs.collect()}
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema == docs.schema
            assert all(tuple(r) == kept[r["doc_id"]] for r in out.collect())
        assert bool(corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()) == bool(given)
