"""Aligned tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from noticeloom.llm import alignment
from noticeloom.llm.queries import BYTE_BPE, PIECE_BPE

ODD = ["a\r\nb;\r\n c", "x ▁y", " ", "  ", "\n", "x;\r\n\r\n y", "\x1c a\x1c b!\x1c", "é   b c  \t d", "<|endoftext|> <s> </s> <0x41>", "日本 語　テ", "a\x00b", " \r", "tail \n \n", "naïve 🙂🙂 x", "a\x85b \xa0\xa0c", "", None]


def brute(rows):
    """Per row the contract's columns, from the tokenizers themselves and plain loops."""
    a_side, b_side = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_side.encode_special_tokens = True
    letters = alignment.byte_letters()
    told, links = [], []
    for _, text in rows:
        raw = f" {text}".encode()
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            told.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, {}
            for k, p in enumerate(parts):
                at += len(p)
                own[at] = k
            ends.append(own)
        groups, own, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            own.append((a[k], b[m]))
            i, j = k + 1, m + 1
        told.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    counts = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(doc, *t[:3], len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), t[3]) for (doc, _), t, own in zip(rows, told, links)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_align_is_the_contract(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 9)
    monkeypatch.setattr(alignment, "PORTION", 300)
    monkeypatch.setattr(alignment, "PAIRS", 200)
    monkeypatch.setattr(alignment, "STREAM_BYTES", 500)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("th er an in on The Éa ß 12 , . !".split()) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)] + ODD
    texts += ["".join(rng.choice("ab;)({ \r\n\t\xa0　1é🙂's▁") for _ in range(20)) for _ in range(60)]
    texts += [texts[3]] * 5 + [" the" * 3000]
    rows = [(None if k % 17 == 3 else k // 2, t) for k, t in enumerate(texts)]  # ids repeat, some are null
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    assert ordered(alignment.align(docs, BYTE_BPE, PIECE_BPE).collect()) == ordered(brute(rows))


def test_groups_are_those_of_the_digest(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    told = {r["doc_id"]: r["groups"] for r in alignment.groups(docs, BYTE_BPE, PIECE_BPE).collect()}
    want = {r[0]: r[-1] for r in brute(list(enumerate(ODD)))}
    assert {k: hashlib.sha256(g.encode()).hexdigest() if g else "" for k, g in told.items()} == want


def test_align_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = alignment.align(empty, BYTE_BPE, PIECE_BPE)
    assert out.collect() == [] and out.columns[0] == "doc_id"
    bare = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), BYTE_BPE, PIECE_BPE)
    assert ordered(bare.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
