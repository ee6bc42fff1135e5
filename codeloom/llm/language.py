"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters of the lower-cased text, with every run of other than letters as one blank, give hashed n-grams of one to three
characters. Weights are learned per coordinate by follow-the-regularised-leader with an elastic net penalty (L1 keeps them
sparse), and a temperature, found on a part held out of the training sample, calibrates the probabilities. Scoring reads
every whole text in Arrow batches.

The model is fitted on a bounded sample: about PER_LANG rows a language, or SAMPLE_ROWS in all where there are very many languages
(LEAST_PER_LANG at least), chosen by a hash of the document id. Every labelled language is learned. The sample's n-gram counts, at
most DIMS a row, are made on the executors.

Defined cases: null texts and texts without a letter are `und` with score 0; rows with null language are not learned from;
without any labelled row every text is `und`; equal texts get equal answers; ties go to the first language in order; rows of the
sample are put in order by their language and counts, so equal ones are interchangeable; texts of any length are read whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, text_udf

UND = "und"
#: Rows of a language that the sample has on average at most, of all languages, and yet of a language.
PER_LANG, SAMPLE_ROWS, LEAST_PER_LANG = 600, 60_000, 20
#: Languages up to which their counts are broadcast.
MOST_BROADCAST = 100_000
DIMS = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of a text's character n-grams; both empty if it has no letter."""
    text = " " + " ".join("".join([c if c.isalpha() else " " for c in (text or "").lower()]).split()) + " "
    if text.isspace():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    shift = np.uint64(64 - 15)
    pair = c[:-1] * np.uint64(1 << 21) + c[1:]
    triple = pair[:-1] * np.uint64(0x100000001B3) + c[2:]
    keys = np.concatenate(((c + np.uint64(1)) * MIX >> shift, (pair + np.uint64(7)) * MIX >> shift, (triple + np.uint64(11)) * MIX >> shift))
    counts = np.bincount(keys.astype(np.int64), minlength=DIMS)
    dims = np.flatnonzero(counts)
    return dims, counts[dims]


def weigh(dims: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[dims]
    return x / max(1e-12, float(np.sqrt((x * x).sum())))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 7) -> dict:
    """FTRL-proximal with elastic net over (dims, counts, class); then the temperature on every fifth row."""
    order = np.random.default_rng(seed).permutation(len(rows))
    held = [rows[k] for k in order[::5]] if len(rows) >= 10 else rows
    fit = [rows[k] for n, k in enumerate(order) if n % 5] if len(rows) >= 10 else rows
    df = np.zeros(DIMS)
    for dims, _, _ in fit:
        df[dims] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    bias_z, bias_n = np.zeros(classes), np.zeros(classes)

    def solved(z, n, l1=l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    ready = [(d, weigh(d, c, idf), y) for d, c, y in fit]
    for _ in range(epochs):
        for dims, x, y in ready:
            w, b = solved(z[dims], n[dims]), solved(bias_z, bias_n, 0.0)
            g = softmax(x @ w + b)
            g[y] -= 1
            grad = x[:, None] * g
            z[dims] += grad - (np.sqrt(n[dims] + grad**2) - np.sqrt(n[dims])) / alpha * w
            n[dims] += grad**2
            bias_z += g - (np.sqrt(bias_n + g**2) - np.sqrt(bias_n)) / alpha * b
            bias_n += g**2
    weights, bias = solved(z, n), solved(bias_z, bias_n, 0.0)
    logits = np.array([weigh(d, c, idf) @ weights[d] + bias for d, c, _ in held])
    truth = np.array([y for _, _, y in held])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 121), key=loss) if len(held) else 1.0
    return {"idf": idf, "weights": weights, "bias": bias, "temperature": float(temperature)}


def sample(docs: DataFrame, usable: Column, lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang) of about per_lang usable rows a language, or all where there are fewer."""
    labelled = docs.where(usable & F.col(lang).isNotNull()).select("doc_id", "text", F.col(lang).alias("lang"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.count()
    most = float(min(per_lang, max(LEAST_PER_LANG, SAMPLE_ROWS // max(1, langs))))
    part = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    # one row a language
    counts = F.broadcast(counts) if langs <= MOST_BROADCAST else counts
    return labelled.join(counts, "lang").where(part < F.lit(most) / F.col("n")).select("text", "lang")


def fit(docs: DataFrame, usable: Column, lang: str = "lang", per_lang: int = PER_LANG) -> dict | None:
    """The model from a bounded sample; its n-gram counts are made on the executors."""

    def each(batch) -> dict:
        out = {"lang": batch.column(1), "dims": [], "counts": []}
        for t in batch.column(0):
            d, c = ngrams(t.as_py())
            out["dims"].append(d.astype(np.int32))
            out["counts"].append(c.astype(np.int32))
        return out

    got = arrow_rows(sample(docs, usable, lang, per_lang), ["text", "lang"], "lang string, dims array<int>, counts array<int>", each).toArrow()
    langs = got.column("lang").to_pylist()
    names = sorted(set(langs))
    if not names:
        return None
    number = {y: k for k, y in enumerate(names)}
    rows = [(np.asarray(d.values, dtype=np.int64), np.asarray(c.values, dtype=np.int64), number[y]) for d, c, y in zip(got.column("dims"), got.column("counts"), langs) if len(d.values)]
    if not rows:
        return None
    rows.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # a total order: rows equal in it are interchangeable
    return train(rows, len(names)) | {"names": names}


def answer(text: str | None, m: dict | None) -> tuple[str, float]:
    """Language and calibrated probability of one text."""
    d, c = ngrams(text) if m else ((), ())
    if not len(d):
        return UND, 0.0
    p = softmax((weigh(d, c, m["idf"]) @ m["weights"][d] + m["bias"]) / m["temperature"])
    k = int(p.argmax())
    return m["names"][k], float(p[k])


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch) -> dict:
        made = [answer(t.as_py(), held.value) for t in batch.column(1)]
        return {"doc_id": batch.column(0), "lang_pred": [a for a, _ in made], "score": [b for _, b in made]}

    return arrow_rows(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", each)


def identified(docs: DataFrame, model: dict | None, least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose language is found with a probability of at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(text: str | None) -> bool:
        lang, p = answer(text, held.value)
        return lang != UND and p >= least

    return docs.where(text_udf(docs.sparkSession, "boolean", each)("text"))
