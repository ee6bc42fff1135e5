"""Lexical validation: which words predict a score, by sparse models and their stability under resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.config import LexicalSettings
from codeloom.functions.kernels import STOPWORDS
from codeloom.functions.solvers import lasso
from codeloom.runtime import ship

#: Texts and terms that the dense solver takes.
MOST_TEXTS, MOST_TERMS = 20_000, 5_000
ALPHAS = (0.1, 0.03, 0.01, 0.003, 0.001)
TARGETS = ("count", "ge1", "ge3")
SPACES = ("tfidf", "presence")


def terms(scored: DataFrame) -> DataFrame:
    """(response_id, term, tf) of scored (response_id, text, score)."""
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), 0), lambda t: ~t.isin(*sorted(STOPWORDS)))
    return scored.select("response_id", F.explode(found).alias("term")).groupBy("response_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(scored: DataFrame, min_df: int = 2) -> DataFrame:
    return terms(scored).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def tfidf(scored: DataFrame, min_df: int = 2) -> DataFrame:
    """(response_id, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length per text."""
    n = scored.agg(F.countDistinct("response_id").alias("n"))
    x = terms(scored).join(document_frequency(scored, min_df), "term").crossJoin(F.broadcast(n))
    raw = x.withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    size = raw.groupBy("response_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, "response_id").select("response_id", "term", (F.col("w") / F.col("size")).alias("weight"))


def score_distribution(scored: DataFrame) -> DataFrame:
    """One row: texts, mean score, and how the cuts at 1 and 3 divide them (2 is below 3)."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.sum((F.col("score") >= 1).cast("long")).alias("ge1"), F.sum((F.col("score") >= 3).cast("long")).alias("ge3"))


def scored_from_assignments(texts: DataFrame, occ: DataFrame, family: str | None = None) -> DataFrame:
    """(response_id, text, score): the number of distinct codes, or of those of one family; 0 without any."""
    from codeloom.functions.names import family_of

    own = occ if family is None else occ.where(family_of("code") == family)
    n = own.groupBy("response_id").agg(F.countDistinct("code").alias("score"))
    return texts.join(n, "response_id", "left").select("response_id", "text", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def _target(score: np.ndarray, target: str) -> tuple[np.ndarray, str]:
    return (score.astype(float), "poisson") if target == "count" else ((score >= int(target[2:])).astype(float), "logistic")


def _folds(y: np.ndarray, k: int, rng) -> np.ndarray:
    fold = np.zeros(len(y), dtype=int)
    for v in np.unique(y):
        at = rng.permutation(np.flatnonzero(y == v))
        fold[at] = np.arange(len(at)) % k
    return fold


def _fit(x: np.ndarray, y: np.ndarray, loss: str, alpha: float | None, folds: int, rng) -> tuple[np.ndarray, float]:
    """Coefficients at the penalty with the least held-out loss (or at the one given), and that penalty."""
    if alpha is None:
        fold, lost = _folds(y, folds, rng), {}
        for a in ALPHAS:
            lost[a] = 0.0
            for k in range(folds):
                w, b = lasso(x[fold != k], y[fold != k], a, loss, 200)
                z = np.clip(x[fold == k] @ w + b, -30, 30)
                lost[a] += float((np.exp(z) - y[fold == k] * z).sum() if loss == "poisson" else (np.logaddexp(0, z) - y[fold == k] * z).sum())
        alpha = min(ALPHAS, key=lambda a: (lost[a], -a))
    return lasso(x, y, alpha, loss, 400)[0], alpha


def validate(scored: DataFrame, settings: LexicalSettings = LexicalSettings(), seed: int = 1729) -> DataFrame:
    """(target, space, term, coefficient, rank, stability) of the top words of six fits, three targets in two spaces; the
    stability is the share of stratified resamples in whose top words a word is. Each fit is one task, and so is each of its
    resamples; the table of texts and terms is bounded (MOST_TEXTS, MOST_TERMS) and read once, as a broadcast."""
    spark = scored.sparkSession
    ship(spark)
    weights = tfidf(scored, settings.min_df)
    if scored.limit(MOST_TEXTS + 1).count() > MOST_TEXTS:
        raise ValueError(f"lexical validation takes at most {MOST_TEXTS} texts")
    vocabulary = [r["term"] for r in document_frequency(scored, settings.min_df).orderBy(F.desc("df"), "term").limit(MOST_TERMS).collect()]
    base = scored.select("response_id", "score").orderBy("response_id").toPandas()
    cells = weights.where(F.col("term").isin(vocabulary)).toPandas() if vocabulary else pd.DataFrame(columns=["response_id", "term", "weight"])
    score = base["score"].to_numpy()
    for cut in (1, 3):
        if min((score >= cut).sum(), (score < cut).sum()) < settings.min_per_class:
            raise ValueError(f"fewer than {settings.min_per_class} texts on one side of score {cut}")
    names = sorted(vocabulary)
    x = np.zeros((len(base), len(names)))
    x[cells["response_id"].map({r: k for k, r in enumerate(base["response_id"])}).to_numpy(dtype=int), cells["term"].map({t: k for k, t in enumerate(names)}).to_numpy(dtype=int)] = cells["weight"]
    shared = spark.sparkContext.broadcast((x, score, names))
    top = settings.top_words

    def best(w: np.ndarray, names: list[str]) -> list[int]:
        return sorted(np.flatnonzero(w), key=lambda k: (-abs(w[k]), names[k]))[:top]

    def run(batches):
        x, score, names = shared.value
        for b in batches:
            out = []
            for target, space, sample in zip(b["target"], b["space"], b["sample"]):
                y, loss = _target(score, target)
                z = x if space == "tfidf" else (x > 0).astype(float)
                rng = np.random.default_rng([seed, sample, TARGETS.index(target), SPACES.index(space)])
                if sample:
                    rows = np.concatenate([rng.choice(np.flatnonzero(score == v), (score == v).sum()) for v in np.unique(score)])
                    w, _ = _fit(z[rows], y[rows], loss, 0.01, settings.folds, rng)
                else:
                    w, _ = _fit(z, y, loss, None, settings.folds, rng)
                out += [(target, space, int(sample), names[k], float(w[k]), r) for r, k in enumerate(best(w, names), 1)]
            yield pd.DataFrame(out, columns=["target", "space", "sample", "term", "coefficient", "rank"])

    jobs = spark.createDataFrame([(t, s, k) for t in TARGETS for s in SPACES for k in range(settings.bootstraps + 1)], "target string, space string, sample int").repartition(16, "sample", "target", "space")
    found = jobs.mapInPandas(run, "target string, space string, sample int, term string, coefficient double, rank int")
    share = found.where("sample > 0").groupBy("target", "space", "term").agg((F.count(F.lit(1)) / settings.bootstraps).alias("stability"))
    return found.where("sample = 0").drop("sample").join(share, ["target", "space", "term"], "left").na.fill(0.0, ["stability"])


def top_words(weights: DataFrame, k: int = 20) -> DataFrame:
    """(target, space, term, coefficient) of the k largest by size, ties by term."""
    w = Window.partitionBy("target", "space").orderBy(F.desc(F.abs("coefficient")), "term")
    return weights.where("coefficient <> 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def keyword_in_context(texts: DataFrame, word: str, width: int = 70) -> DataFrame:
    """(response_id, excerpt) around the first occurrence of a word."""
    at = F.instr(F.lower("text"), word.lower())
    start = F.greatest(F.lit(1), at - (width - len(word)) // 2)
    return texts.where(at > 0).select("response_id", F.trim(F.substring(F.col("text"), start, F.lit(width))).alias("excerpt"))
