"""Importance resampling against brute force, and CRCs of joined strings against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from noticeloom.llm import resampling


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, percent=25, least=20, longest=2):
    own = [(d, *features(t, longest)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x, longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000.0) / ((s[b] + 1.0) * (n_t + 10_000.0))))
    out = []
    for doc, words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    drawable = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(drawable[: percent * len(drawable) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice(["ka", "Lo", "mi", "é", "x1", "日"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", "\x00"]) for _ in range(n))
    docs = [(k * 3 % 101, text(rng.randint(0, 60))) for k in range(90)]
    docs += [(200, None), (201, ""), (202, "A"), (203, "!!"), (204, "a" * 5000 + " " + "b" * 300 + " c"), (205, text(4000)), (None, text(30))]
    return docs, [text(20) for _ in range(12)] + [None, ""]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_is_the_formula(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "BLOCK_LETTERS", 700)
    docs, target = corpus()
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, rank int, key string").repartition(3)
    aimed = spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int")
    got = sorted((tuple(r) for r in resampling.resample(df, aimed, longest=longest).collect()), key=str)
    assert got == sorted(brute(docs, target, longest=longest), key=str)


def test_repeated_rows_have_ranks_of_their_own(spark):
    docs = [(1, " ".join(["same"] * 25))] * 40 + [(2, " ".join(["other"] * 25))] * 40
    rows = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([("same",)], "text string")).collect()
    assert len(rows) == 80 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 21))


def test_nothing_to_draw_from(spark):
    empty, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert resampling.resample(empty, one.select("text")).collect() == []
    (row,) = resampling.resample(one, empty.select("text")).collect()
    assert tuple(row) == brute([(5, "a b")], [])[0] and row["rank"] is None


def test_crc_of_joined_strings():
    crc, rng = resampling.Crc(), random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(n)) for n in [*range(130), 1000, 65_536, 1_000_003]]
    got = crc.joined(*(np.array(x, np.int64) for x in zip(*((zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in pairs))))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
