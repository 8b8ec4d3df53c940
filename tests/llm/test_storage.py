"""Packing, token store, compaction: brute force, round trips, edge rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticeloom.llm import compaction, encoding, packing, token_store

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, world!! don't", "Ärger é café Σσ <|endoftext|> İ", "x " * 5000, "same words here", "same words here", " \t\n ", "日本 1234"]
SCHEMA = "doc_id long, text string, score double, piece string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def docs(spark, texts):
    return spark.createDataFrame([(i if i != 5 else 6, t, 1.0, "clash") for i, t in enumerate(texts)] + [(None, "no id", None, None)], SCHEMA)


def test_encoder_is_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_CHUNKS", 500)
    rng = random.Random(1)
    signs = "abzABZ éÉüßÀØ÷.,!?'%*# \n\t  ́İΣσ0日<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [t or "" for t in TEXTS]
    own = encoding.Encoder(WORD_BPE)
    got = own.encode([t.encode() for t in texts])
    assert own.by_chunk
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_other_tokenizers_get_whole_texts(tmp_path):
    """One that keeps case and blanks does not answer by chunks."""
    from tokenizers import models, normalizers, pre_tokenizers

    for k, (normalizer, splitter) in enumerate([(None, None), (normalizers.NFC(), pre_tokenizers.ByteLevel(add_prefix_space=False))]):
        letters = sorted(set(pre_tokenizers.ByteLevel.alphabet()) | set("abcdefghijklmnopqrstuvwxyz "))
        own = Tokenizer(models.BPE({c: i for i, c in enumerate(letters)}, []))
        if splitter:
            own.normalizer, own.pre_tokenizer = normalizer, splitter
        own.save(str(tmp_path / f"{k}.json"))
        texts = ["Hello World  two", "a\nb", "ÉÉ x", ""]
        got = encoding.Encoder(str(tmp_path / f"{k}.json")).encode([t.encode() for t in texts])
        assert got == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plan_needs_no_more_sequences_than_plain_best_fit():
    rng = random.Random(3)
    for cap in (7, 50, 64):
        for _ in range(20):
            lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 300))]
            room: list[int] = []
            for n in sorted(lengths, reverse=True):
                fits = [k for k, r in enumerate(room) if r >= n]
                if fits:
                    room[min(fits, key=lambda k: room[k])] -= n
                else:
                    room.append(cap - n)
            _, used = packing.plan_slots({n: lengths.count(n) for n in set(lengths)}, cap)
            assert used <= len(room)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for cap in (10, 64):
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, cap + 1), min(cap, 20))}
        runs, used = packing.plan_slots(histogram, cap)
        filled: dict[int, list] = {}
        for (length, first, each, seq, offset), nxt in zip(sorted(runs), [*sorted(runs)[1:], None]):
            stop = nxt[1] if nxt and nxt[0] == length else histogram[length]
            for k in range(stop - first):
                filled.setdefault(seq + k // each, []).append((offset + k % each * length, length))
        assert sum(len(v) for v in filled.values()) == sum(histogram.values()) and len(filled) == used
        for places in filled.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= cap
    assert packing.plan_slots({}, 8) == ([], 0)


def test_pack_and_store(spark, tokenizer):
    df = docs(spark, TEXTS)
    rows = packing.pack(df, WORD_BPE).collect()
    want = sorted(((i if i is not None else -1), p, s, zlib.crc32(a[s : s + 2048].tobytes())) for i, t in df.select("doc_id", "text").collect() for a in [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")] for p, s in enumerate(range(0, len(a), 2048)))
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["piece"], r["start"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(df.limit(0), WORD_BPE).count() == 0
    store = token_store.write_store(df, WORD_BPE, shard_ids=3000)
    back = token_store.read_store(store).orderBy("start").collect()
    assert [r["start"] for r in back] == np.r_[0, np.cumsum([r["n_tokens"] for r in back])][:-1].tolist() and [r["doc_id"] for r in back][1:] == sorted(r["doc_id"] for r in back[1:])
    crcs = sorted(zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in df.select("doc_id", "text").collect())
    assert sorted(r["ids_crc32"] for r in back) == crcs
    assert token_store.read_store(token_store.write_store(df.limit(0), WORD_BPE)).count() == 0


def test_shard_decodes_at_random():
    rng = np.random.default_rng(0)
    encoded = [np.tile(rng.integers(0, 50, 40), 60).astype("<u4")[: rng.integers(1, 2400)].tobytes() for _ in range(30)]
    body = token_store.pack_shard(list(range(30)), encoded)
    shard = token_store.Shard(body)
    assert len(shard.rules) and len(body) < sum(map(len, encoded)) / 2
    for k, e in enumerate(encoded):
        ids = np.frombuffer(e, "<u4")
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.document(k) == ids).all() and (shard.document(k, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("top", [40, 65_500, 65_535, 70_000])
def test_grammar_goes_on_until_no_pair_pays(top):
    from collections import Counter

    rng = np.random.default_rng(top)
    phrases = [rng.integers(0, 40, rng.integers(2, 30)) for _ in range(60)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 60, rng.integers(1, 60))]) for _ in range(80)] + [np.array([top]), np.full(500, 7)]
    ids, last = np.concatenate(docs).astype(np.uint32), np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    seq, ends, rules, base = token_store.re_pair(ids, last)
    body = token_store.pack_shard(list(range(len(docs))), [d.astype("<u4").tobytes() for d in docs])
    shard = token_store.Shard(body)
    assert (shard.expand(shard.symbols) == ids).all() and base == top + 1 and (shard.sizes == token_store.expansion_lengths(rules, base)).all()
    left = Counter(zip(seq[:-1][~ends[:-1]].tolist(), seq[1:][~ends[:-1]].tolist()))
    if top != 65_500 and top != 65_535:  # symbols' width is settled
        assert max(n for (a, b), n in left.items() if a != b) < token_store.LEAST * 2


def test_compaction(spark, tmp_path):
    root = str(tmp_path / "table")
    for k in range(9):
        compaction.append(spark.range(k * 100, k * 100 + 100).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1), root)
    before = compaction.manifest(spark, root).count()
    version = compaction.compact(spark, root, target=1 << 20, fanout=4)
    assert before == 9 and compaction.manifest(spark, root).count() == 1 and compaction.versions(spark, root)[-1] == version
    assert sorted(r["id"] for r in compaction.read(spark, root).collect()) == list(range(900))
    assert compaction.read(spark, root, version - 1).count() == 900
    assert compaction.compact(spark, root, target=1 << 20) == version
    with pytest.raises(RuntimeError):
        compaction.commit(spark, root, compaction.manifest(spark, root), version - 1)
    assert len(compaction.expire(spark, root)) == 9 and compaction.read(spark, root).count() == 900
    compaction.append(spark.range(0).withColumn("text", F.lit("x")), root)
    assert compaction.read(spark, root).count() == 900


def test_compaction_of_nothing_and_of_clashing_columns(spark, tmp_path):
    root = str(tmp_path / "empty")
    compaction.append(spark.range(0).withColumn("text", F.lit("x")), root)
    assert compaction.compact(spark, root) == 1 and compaction.read(spark, root).columns == ["id", "text"] and compaction.read(spark, root).count() == 0
    with pytest.raises(ValueError):
        compaction.read(spark, str(tmp_path / "never"))
    root = str(tmp_path / "clash")
    rows = [(1, "a", None), (1, "a", None), (None, None, 5), (2, "x" * 100_000, 5)]
    for _ in range(6):
        compaction.append(spark.createDataFrame(rows, "noticeloom_bin int, noticeloom_path string, bin int").repartition(2), root)
    compaction.compact(spark, root, target=1 << 20)
    back = compaction.read(spark, root)
    assert back.columns == ["noticeloom_bin", "noticeloom_path", "bin"] and sorted(map(str, back.collect())) == sorted(str(r) for r in 6 * spark.createDataFrame(rows, back.schema).collect())


def test_every_bin_is_a_file(spark, tmp_path):
    root = str(tmp_path / "bins")
    for k in range(16):
        compaction.append(spark.range(k * 500, k * 500 + 500).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1), root)
    compaction.compact(spark, root, target=100_000)
    shards = compaction.manifest(spark, root).collect()
    assert 1 < len(shards) < 16 and {s["generation"] for s in shards if s["rows"] > 500} == {1} and max(s["rows"] for s in shards) <= 3500
    assert sorted(r["id"] for r in compaction.read(spark, root).collect()) == list(range(8000))
