import random

import corpus_pipeline as cp
from codeloom.llm import near_copies as nc
from codeloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, words=5, least=0.8):
    """The least id of every row's component."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                label = [label[b] if x == label[a] else x for x in label]
    return {min(i for (i, _), x in zip(rows, label) if x == y) for y in set(label)}


def planted():
    r = random.Random(5)
    prose = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows = []
    for base in range(12):
        text = prose(r.randint(100, 300))
        rows.append((base * 100, " ".join(text)))
        for k in range(12):
            other = list(text)
            for _ in range(r.randint(0, len(text) // 25)):
                other[r.randrange(len(other))] = f"x{r.randint(0, 5000)}"
            rows.append((base * 100 + k + 1, " ".join(other)))
    rows += [(9000 + k, " ".join(prose(50))) for k in range(30)]
    return rows + [(9900, "one two"), (9901, "One  two"), (9902, "one two three"), (9903, None), (9904, ""), (9905, rows[0][1])]


def test_stage_keeps_one_of_copies_of_similarity_from_0_8(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(5)
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(brute(rows))
    assert cp.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_fingerprints_reach_pairs_of_0_8():
    r = random.Random(6)
    hit = 0
    for _ in range(300):
        text = [f"w{r.randint(0, 9999)}" for _ in range(225)]
        other = list(text)
        for k in range(5):  # 25 of 221 shingles change: similarity 0.797
            other[20 + 40 * k] = "x"
        hit += bool(set(nc.bands(nc.min_hashes(nc.shingles(" ".join(text))))) & set(nc.bands(nc.min_hashes(nc.shingles(" ".join(other))))))
    assert hit >= 297


def test_clashing_columns_are_kept(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words are here at last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as kid", "8 as __kid", "9 as cls", "10 as key", "'x' as `a.b`", "11 as label")
    for got in (cp.drop_near_duplicates(spark, docs, ""), simhash.representatives(docs)):
        assert got.columns == docs.columns
        assert sorted(tuple(r) for r in got.collect()) == [(1, rows[0][1], 7, 8, 9, 10, "x", 11), (3, rows[2][1], 7, 8, 9, 10, "x", 11)]


def test_loose_copies_of_one_text_are_linked_as_by_brute_force(spark):
    r = random.Random(8)
    text = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    rows = [(0, " ".join(text))]
    for k in range(1, 90):  # similarities of 0.3 to 0.95, so most are no links though they share fingerprints
        other = list(text)
        for _ in range(r.randint(1, 9)):
            other[r.randrange(len(other))] = f"x{r.randint(0, 20)}"
        rows.append((k, " ".join(other)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)
    kept = sorted(r["doc_id"] for r in nc.representatives(docs).collect())
    assert kept == sorted(brute(rows))
    assert 1 < len(kept) < 80


def test_prefix_pairs_hold_all_similar_pairs(spark):
    r = random.Random(9)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for k in range(60):
        t = list(base[k % 6])
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = f"y{r.randint(0, 9)}"
        texts.append(" ".join(t[: r.randint(50, 60)]))
    keyed = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "kid long, kth long, text string")
    classes = keyed.selectExpr("kid as cls", "named_struct('kid', kid, 'kth', kth) as key")
    open_ = keyed.selectExpr("kid as cls", "kid as label", "kid % 2 = 0 as apart")
    got = {tuple(x) for x in nc._prefix_pairs(open_, classes, keyed, 5, 0.8).collect()}
    sets = [nc.shingles(t) for t in texts]
    want = {(a, b) for a in range(60) for b in range(a) if (a % 2 == 0 or b % 2 == 0) and nc.similar(sets[a], sets[b], 0.8)}
    assert want and want <= got


def test_chained_pairs_grow_with_the_classes_and_skip_equal_labels(spark):
    # 300 classes in one bucket, of which the odd ones are one component already, and a bucket of one component
    rows = [(1, c, 0, 300, 1 if c % 2 else c, 1) for c in range(300)] + [(2, c, 1000, 50, 1000, 1000) for c in range(1000, 1050)]
    held = spark.createDataFrame(rows, "bucket long, cls long, centre long, n long, label long, most long")
    pairs = {(r["a"], r["b"]) for r in nc._chained(held).collect()}
    assert all(a > b and not (a % 2 and b % 2) for a, b in pairs)
    assert 300 < len(pairs) <= 300 * nc.REACH
    assert all(a < 300 for a, _ in pairs)
