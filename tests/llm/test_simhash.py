import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import simhash as sh
from codeloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget):
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= budget:
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(ids))]


def test_fingerprints(spark):
    texts = [None, "", "A", "One two", "one  TWO\tthree\nfour É", "a b c a b c a b c", " x ", "word " * 500]
    for t in texts:
        assert sh.fingerprint(t) == brute_fingerprint(t) and sh.fingerprint(t, 5) == brute_fingerprint(t, 5)
    # Spark's own function has the same seed
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def planted(seed, n):
    r = random.Random(seed)
    fps = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = r.choice(fps)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    return fps


@pytest.mark.parametrize(("seed", "subtrie", "budget"), [(1, 20_000, 2), (2, 3, 2), (3, 1, 2), (4, 20_000, 3), (5, 2, 3)])
def test_links_connect_what_brute_force_connects(spark, seed, subtrie, budget):
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in planted(seed, 150)})
    edges = sh.links(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5), budget, subtrie)
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    have = [found.get(x, x) for x in fps]
    want = brute_components(fps, [x % (1 << 64) for x in fps], budget)
    assert have == want


def test_trie_finds_every_link():
    r = np.random.default_rng(4)
    x = r.integers(0, 1 << 16, 300).astype(np.uint64)  # many near ones in the low bits
    x = np.unique(x)
    a, b = sh.trie_links(x, [(0, len(x), 0, len(x))], 0, 2)
    want = {(i, j) for i in range(len(x)) for j in range(i) if bin(int(x[i]) ^ int(x[j])).count("1") <= 2}
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 202), (200, 202)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 200, 201: 200, 202: 200}


def test_stars_take_no_step(spark, monkeypatch):
    from codeloom.llm import components as module

    made, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, label, *a: made.append(label) or cut(df, label, *a))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([(5, 1), (1, 7), (9, 8), (4, 4)], "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8, 4: 4} and made == ["edges"]
    # one step makes a path of two edges a star, and none comes after it
    assert {r["component"] for r in components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()} == {1}
    assert made[1:].count("small") == 1
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_documents(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(5, base), (3, base), (9, base.replace("word7 ", "other ")), (4, None), (8, ""), (11, "something else entirely here"), (11, "something else entirely here")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 as fp", "2 as least")
    got = {(r["doc_id"], r["component_id"]) for r in sh.near_duplicates(docs).collect()}
    ids = [i for i, _ in rows]
    want = brute_components(ids, [brute_fingerprint(t) for _, t in rows], 2)
    assert got == set(zip(ids, want)) and sh.near_duplicates(docs).count() == len(rows)
    kept = sh.representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert sh.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
