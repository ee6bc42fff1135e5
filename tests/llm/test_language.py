import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import language as lg

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=300):
    r = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["ção", "nho", "lha", "em"]}
    return [(k, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang, "s", 1) for k, lang in enumerate(r.choices(list(parts), k=n))]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus() + [(1000, None, "aa", None, None), (1001, "123 !!", "bb", None, None), (1002, "", None, None, None), (1003, "kalo mita", None, None, None), (1003, "kalo mita", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))
    model = lg.fit(docs, F.col("doc_id") % 5 != 0)
    got = lg.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows[:300] if r[0] % 5 == 0]
    assert np.mean([by[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)
    kept = lg.identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(by) - {1000, 1001, 1002}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    assert lg.fit(docs, F.lit(True)) is None
    assert lg.predict(docs, None).first()["lang_pred"] == "und"
    empty = spark.createDataFrame([], DOCS)
    assert lg.predict(empty, lg.fit(empty, F.lit(True))).count() == 0


def test_penalty_makes_weights_sparse_and_temperature_calibrates():
    rows = [(*lg.ngrams(t), {"aa": 0, "bb": 1, "cc": 2}[lang]) for _, t, lang, _, _ in corpus(200)]
    loose, tight = lg.train(rows, 3, l1=0.0), lg.train(rows, 3, l1=0.05)
    assert np.count_nonzero(tight["weights"]) < np.count_nonzero(loose["weights"])
    assert tight["temperature"] > 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame(corpus(900), DOCS)
    assert lg.sample(docs, F.lit(True), per_lang=50).count() < 3 * 90


def naive(rows, classes, epochs, alpha, beta, l1, l2, seed):
    """FTRL-proximal coordinate by coordinate, over dictionaries."""
    import math

    order = np.random.default_rng(seed).permutation(len(rows))
    fit = [rows[k] for n, k in enumerate(order) if n % 5]
    df = {}
    for d, _, _ in fit:
        for x in d.tolist():
            df[x] = df.get(x, 0) + 1
    z, n, bz, bn = {}, {}, [0.0] * classes, [0.0] * classes
    solve = lambda a, b, p: 0.0 if abs(a) <= p else -(a - math.copysign(p, a)) / ((beta + math.sqrt(b)) / alpha + l2)
    for _ in range(epochs):
        for dims, counts, y in fit:
            x = {d: (1 + math.log(c)) * (math.log((1 + len(fit)) / (1 + df[d])) + 1) for d, c in zip(dims.tolist(), counts.tolist())}
            size = math.sqrt(sum(v * v for v in x.values()))
            w = {(d, k): solve(z.get((d, k), 0.0), n.get((d, k), 0.0), l1) for d in x for k in range(classes)}
            b = [solve(bz[k], bn[k], 0.0) for k in range(classes)]
            e = [math.exp(b[k] + sum(v / size * w[d, k] for d, v in x.items())) for k in range(classes)]
            for k in range(classes):
                g = e[k] / sum(e) - (k == y)
                for d, v in x.items():
                    gd, old = g * v / size, n.get((d, k), 0.0)
                    z[d, k] = z.get((d, k), 0.0) + gd - (math.sqrt(old + gd * gd) - math.sqrt(old)) / alpha * w[d, k]
                    n[d, k] = old + gd * gd
                old = bn[k]
                bz[k] += g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * b[k]
                bn[k] = old + g * g
    return {key: solve(z[key], n[key], l1) for key in z}


def test_weights_equal_brute_force():
    rows = [(*lg.ngrams(t), {"aa": 0, "bb": 1, "cc": 2}[lang]) for _, t, lang, _, _ in corpus(25)]
    got = lg.train(rows, 3, epochs=2)["weights"]
    want = naive(rows, 3, 2, 0.5, 1.0, 0.002, 0.01, 7)
    assert all(abs(got[d, k] - v) < 1e-9 for (d, k), v in want.items())
    assert np.count_nonzero(got) == sum(v != 0 for v in want.values())


def test_every_language_is_learned_and_long_texts_are_read_whole(spark):
    rows = [(k, chr(0x4E00 + k // 3) * 5, f"l{k // 3:04d}", None, None) for k in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = lg.sample(docs, F.lit(True)).groupBy("lang").count().count()
    assert got == 500
    d, c = lg.ngrams("ab " * 300_000)
    assert c.sum() > 1_500_000
