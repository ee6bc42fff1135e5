import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import packing as pk
from codeloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def best_fit_decreasing(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(window - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_best_fit_decreasing_one_by_one(seed):
    r = random.Random(seed)
    window = r.choice([7, 16, 40, 64])
    lengths = [r.randint(1, window) for _ in range(r.randint(0, 150))]
    places, seen = {}, Counter()
    for n, first, last, seq, each, base in pk.plan(dict(Counter(lengths)), window):
        for k in range(last - first):
            places.setdefault(seq + k // each, []).append((base + k % each * n, n))
            seen[n] += 1
    assert seen == Counter(lengths)
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(window - sum(n for _, n in x) for x in places.values()) == best_fit_decreasing(lengths, window)


def test_capacity_tree_finds_the_tightest():
    tree, r, have = pk.CapacityTree(100), random.Random(1), Counter()
    for _ in range(500):
        c = r.randint(0, 100)
        if have[c] and r.random() < 0.5:
            have[c] -= 1
            tree.add(c, -1)
        else:
            have[c] += 1
            tree.add(c, 1)
        need = r.randint(0, 100)
        assert tree.tightest(need) == min((k for k, n in have.items() if n and k >= need), default=None)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(tokenizer_path()), pk.encoder(tokenizer_path())
    for t in ["", "plain words, and 123 numbers's", "a<|endoftext|>b", "x" * 9000, " \n\n\t ", "日本語 ééé", "   lead", "tail   ", "\x00\ufeff"]:
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = [None, "", "one"] + [" ".join(r.choice(["alpha", "beta", "γ", "12"]) for _ in range(r.choice([1, 10, 100, 3000]))) for _ in range(60)]
    texts += [texts[5]] * 3
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)] + [(7, texts[7], None, None, None), (None, "no id", None, None, None)], DOCS)
    rows = pk.pack(docs.selectExpr("*", "1 as length", "2 as offset", "3 as rank"), tokenizer_path()).collect()
    exact = Tokenizer.from_file(tokenizer_path())
    for k in range(len(texts)):
        ids = np.array([*exact.encode(texts[k] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == k)
        own = own[::2] if k == 7 else own
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:j]) for j in range(len(own))]
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in own)
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1024
    assert any(x["doc_id"] is None for x in rows)
    assert sum(len(x) for x in by.values()) == len(rows)


def test_ranks_over_buckets_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(pk, "BUCKET_ROWS", 20)
    parts = spark.createDataFrame([(k, 0, 1 + k % 5, k, 9) for k in range(300)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = pk.place(parts, 16).collect()
    assert len(rows) == 300 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 300


def test_empty_table(spark):
    assert pk.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
