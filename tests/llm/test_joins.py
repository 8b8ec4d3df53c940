"""Shingle join, vectors, images, components: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.llm import image_copies, shingle_join, vector_dedup
from noticeloom.llm.shared import connected_components


def smallest(n, links):
    at = list(range(n))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        at[b] = a
    return [top(k) for k in range(n)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(50, 60), (60, 55), (70, 70)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 55: 50, 60: 50}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n, num, den, block", [(3, 90, 100, 256), (5, 8, 10, 3)])
def test_shingle_join_is_exact(spark, n, num, den, block):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for size in (1, 2, 4, 30, 60, 200):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(8):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 20))):
                    t[rng.randrange(size)] = rng.choice(words)
                texts.append(" ".join(t))
    texts += ["", None, " \t", texts[0].upper(), texts[40], "w1 " * 20000]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, size int").repartition(3)
    got = {r["doc_id"]: r for r in shingle_join.join(df, n, num, den, block=block).collect()}
    assert [got[k]["component_id"] for k in range(len(texts))] == smallest(len(texts), links)
    assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]


def test_shingle_join_edge_rows(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (7, "x y z"), (None, "a b c d"), (9, "x y z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in shingle_join.join(df).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert shingle_join.join(df.limit(0)).count() == 0


def test_shingle_join_null_id_before_its_set(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(None, text), (5, text), (9, text + " more")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.join(df).collect()}
    assert got == {None: 5, 5: 5, 9: 5}


def test_vectors_are_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.12 * (i % 4)).tolist(), i) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, [2 * x for x in rows[0][1]], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] + [1.0] * 15, 0), (305, [None] + [1.0] * 15, 0), (306, [1.0, 0.0], 0), (307, [1.0, 0.01], 0), (308, [], 0)]
    vectors = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    links = [(a, b) for a in vectors for b in vectors if a < b and cos(vectors[a], vectors[b])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies int").repartition(3)
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(df).collect()}
    want = smallest(len(rows), links)
    assert [got[k]["component_id"] for k in range(len(rows))] == want
    assert [got[k]["n_links"] for k in range(len(rows))] == [sum(k in link for link in links) for k in range(len(rows))]
    assert all(got[k]["kept"] == (want[k] == k) for k in range(len(rows)))
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_images(spark):
    fields = image_copies.textures(8, 96)
    rng = np.random.default_rng(1)
    one, two = (128 + 45 * np.tensordot(v / np.linalg.norm(v), fields, 1) for v in rng.normal(size=(2, 8)))
    pgm = image_copies.encode
    rows = [(1, pgm(one)), (2, pgm(one[8:90, 6:92])), (3, pgm(one * 1.1 + 8)), (4, pgm(np.rot90(one))), (5, pgm(two)), (6, pgm(two)), (7, None), (8, b"broken"), (9, pgm(np.full((96, 96), 128.0)))]
    got = {r["image_id"]: r for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, body binary")).collect()}
    assert [got[k]["component_id"] for k in range(1, 10)] == [1, 1, 1, 1, 5, 5, 7, 8, 9]
    assert got[7]["n_points"] == got[8]["n_points"] == got[9]["n_points"] == 0 and got[2]["n_agreeing"] >= 8


@pytest.mark.parametrize("block", [2, 5, 256])
def test_images_of_an_entry_all_meet(spark, block):
    rng = random.Random(block)
    component = {i: i // 3 for i in range(40)} | {i: 99 for i in range(40, 70)}
    rows = {(k, i, rng.choice([-128, 0, 3, 90]), *(rng.choice([0, 1, -1, (1 << 20) - 1]) for _ in "xy")) for k in range(30) for i in rng.sample(range(70), rng.choice([1, 3, 12, 50]))}
    rows |= {(100, i, 0, 0, 0) for i in range(40, 70)} | {(101, i, 7, 5, 0) for i in range(38, 70)}
    meet = lambda v, w: sum((x & (1 << 64) - 1 ^ y & (1 << 64) - 1).bit_count() for x, y in zip(v, w)) <= image_copies.WIDE_BITS

    def agreeing(meetings):
        turns = {}
        for a, b, g, h in set(meetings):
            turns.setdefault((a, b), []).append(np.exp(2j * np.pi * (h - g) / image_copies.STEPS))
        return {(*p, len(t)) for p, t in turns.items() if len(t) >= image_copies.MEETINGS and abs(sum(t)) >= image_copies.TURNED}

    want = agreeing((i, j, g, h) for k, i, g, *v in rows for m, j, h, *w in rows if k == m and i < j and component[i] != component[j] and meet(v, w))
    entries = spark.createDataFrame([(*r, component[r[1]]) for r in rows], "entry long, image long, angle int, wide_0 long, wide_1 long, component long").repartition(3)
    least = {k: min(r[1:] for r in rows if r[0] == k) for k, *_ in rows}
    first = agreeing((least[k][0], i, least[k][1], g) for k, i, g, *v in rows if i != least[k][0] and meet(v, least[k][2:]))
    assert {tuple(r) for r in image_copies.turned(image_copies.met_first(entries)).collect()} == first
    assert {tuple(r) for r in image_copies.turned(image_copies.met_apart(entries, block)).collect()} == want


def edited(a, rng):
    """Crops, noise, contrast and turns of a picture."""
    return [a[10:82, 14:86], a[4:88, 20:92], a + rng.normal(0, 4, a.shape), a + rng.normal(0, 8, a.shape), a * 0.8 + 30, np.rot90(a), a // 16 * 16]


def test_edited_copies_are_recalled(spark):
    """520 planted edits of 75 pictures: 0.9 or more are found, and nothing else links."""
    rng = np.random.default_rng(3)
    fields = image_copies.textures(64, 96)
    rows = []
    for k in range(75):
        v = rng.normal(size=64)
        one = 128 + 45 * np.tensordot(v / np.linalg.norm(v), fields, 1)
        rows += [(10 * k + n, image_copies.encode(e)) for n, e in enumerate([one, *edited(one, rng)])]
    got = {r["image_id"]: r["component_id"] for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, body binary").repartition(4)).collect()}
    edits = [i for i in got if i % 10]
    assert len(edits) >= 500 and sum(got[i] == i // 10 * 10 for i in edits) >= 0.97 * len(edits)
    assert all(c // 10 == i // 10 for i, c in got.items())


def test_image_tables_hold_all_tests_and_corners_grow():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 256, (1, 32), np.uint8)
    for word in range(8):  # descriptors that agree in one word of 32 tests only
        other = ~one
        other[:, 4 * word : 4 * word + 4] = one[:, 4 * word : 4 * word + 4]
        assert (image_copies.table_keys(one) == image_copies.table_keys(other)).sum() == 1
    small, large = (len(image_copies.descriptors(128 + 45 * image_copies.textures(1, side)[0])) for side in (96, 384))
    assert small <= 56 and large > 8 * small


def test_small_crop_of_a_large_image(spark):
    picture = 128 + 45 * image_copies.textures(1, 384)[0]
    rows = [(1, image_copies.encode(picture)), (2, image_copies.encode(picture[200:296, 150:246]))]
    got = {r["image_id"]: r["component_id"] for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, body binary")).collect()}
    assert got == {1: 1, 2: 1}


def test_clashing_columns_do_not_matter(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, text, 1, "x", None), (3, text + " more", 2, "y", 1), (9, "alone", 3, "z", 2)], "doc_id long, text string, rep int, key string, component_id int")
    docs = docs.withColumns({n: F.lit(7) for n in ("size", "bits", "band", "text_key", "label", "set_hi")})
    assert {r["doc_id"]: r["component_id"] for r in shingle_join.join(docs).collect()} == {5: 3, 3: 3, 9: 9}
    one = image_copies.encode(128 + 45 * image_copies.textures(1, 96)[0])
    images = spark.createDataFrame([(4, one, "a"), (2, one, "b"), (2, b"P5 broken", "c")], "image_id long, body binary, name string").withColumns({n: F.lit(1) for n in ("points", "image", "entry", "component")})
    got = sorted((r["image_id"], r["n_points"] > 0, r["component_id"]) for r in image_copies.copies(images).collect())
    assert got == [(2, False, 2), (2, True, 2), (4, True, 2)] and image_copies.copies(images.limit(0)).count() == 0
