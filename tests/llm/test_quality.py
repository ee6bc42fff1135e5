import random
import re

from codeloom.llm import quality as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_repeats(words, n=8):
    seen = {}
    for k in range(len(words) - n + 1):
        seen.setdefault(tuple(words[k : k + n]), []).append(k)
    return len({j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + n)})


def test_base_counts_equal_brute_force():
    r = random.Random(3)
    for _ in range(200):
        words = [r.choice("ab") if r.random() < 0.7 else f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 60))]
        assert q.repeated_words(words) == brute_repeats(words)
    text = "one two\n\none two\nthree # *x\n \x0c\none two\u00a0z"
    words, chars, symbols, dup, _ = q.base(text)
    assert words == re.findall(r"[^\x20\x09-\x0D]+", text) and chars == sum(map(len, words))
    assert symbols == 2 and dup == 1


def test_judging(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["plain", "words", "of", "prose", "that", "reads", "well"]) + str(r.randint(0, 50)) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY", "NOW!!", "###", "$$$", "WIN"]) + str(r.randint(0, 50)) for _ in range(60))
    rows = [(k, good() if k % 2 else bad(), None, None, None) for k in range(200)]
    rows += [(500, None, None, None, None), (501, "few words", None, None, None), (502, "same eight words again and again and over " * 9, None, None, None), (503, good(), None, None, None), (504, bad(), None, None, None), (503, good(), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as kept")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.judge(docs, q.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert by[503]["kept"] and not by[504]["kept"] and not by[504]["base_failed"]
    assert by[500]["base_failed"] and by[501]["base_failed"] and by[502]["base_failed"] and by[500]["n_words"] == 0
    assert all(0 <= x["good"] <= 1 for x in got)
    assert q.fit(docs, labels.where("quality = 1")) is None
    alone = {x["doc_id"]: x["kept"] for x in q.judge(docs, None).collect()}
    assert alone[504] and not alone[501]
    assert q.judge(spark.createDataFrame([], DOCS), None).count() == 0


def test_features_equal_brute_force():
    import math
    import zlib

    mod = 1 << 64
    for text in ("one two  two\nthree", "a", "", "é ü é ü é", "x" * 50):
        words = q.WORD.findall(text)
        h = [zlib.crc32(w.encode()) for w in words]
        keys = [x + (1 << 40) for x in h] + [(a * 0x100000001B3 + b) % mod for a, b in zip(h, h[1:])]
        keys += [((ord(a) << 42) + (ord(b) << 21) + ord(c) + (1 << 63)) % mod for a, b, c in zip(text, text[1:], text[2:])]
        counts = {}
        for k in keys:
            d = (k * 0x9E3779B97F4A7C15 % mod) >> (64 - q.BITS)
            counts[d] = counts.get(d, 0) + 1
        want = {d: 1 + math.log(n) for d, n in counts.items()}
        length = math.sqrt(sum(v * v for v in want.values())) or 1
        dims, values = q.features(text, words, q.WordIds())
        assert dims.tolist() == sorted(want) and all(abs(v - want[d] / length) < 1e-9 for d, v in zip(dims.tolist(), values))


def test_the_fit_equals_a_plain_one_and_is_calibrated():
    import numpy as np

    from codeloom.llm import linear

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -2, 0.5] + 0.3)))).astype(float)
    w = linear.logistic(x, y, l2=1.0)
    plain = np.zeros(4)
    wide = np.column_stack([x, np.ones(400)])
    for _ in range(20_000):  # gradient descent on the same loss
        plain -= 0.002 * (wide.T @ (1 / (1 + np.exp(-wide @ plain)) - y) + np.array([1, 1, 1, 1e-6]) * plain)
    assert np.abs(w - plain).max() < 1e-3
    slope, offset = linear.platt(x @ [3.0, -4.0, 1.0], y)
    assert abs((1 / (1 + np.exp(-(slope * (x @ [3.0, -4.0, 1.0]) + offset)))).mean() - y.mean()) < 0.01


def test_very_long_texts_are_read_whole():
    words, chars, symbols, dup, _ = q.base("word # \n" * 100_000)
    assert (len(words), chars, symbols, dup) == (200_000, 500_000, 100_000, 99_999)
