"""Agreement between two codings, and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.texts import interval_jaccard, string_overlap


def cells(human: DataFrame, machine: DataFrame) -> DataFrame:
    """Every response by every code, with whether either side applied it. Only cells that some side fills are stored; the rest
    of the grid is counted, not built: see scores()."""
    h = human.select("response_id", "code").distinct().withColumn("h", F.lit(1))
    m = machine.select("response_id", "code").distinct().withColumn("m", F.lit(1))
    return h.join(m, ["response_id", "code"], "full").na.fill(0, ["h", "m"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(human: DataFrame, machine: DataFrame, digits: int = 6) -> DataFrame:
    """One row: confusion over the whole grid, precision, recall, F1, observed and chance agreement, kappa."""
    filled = cells(human, machine)
    both = human.select("response_id").union(machine.select("response_id"))
    n = both.agg(F.countDistinct("response_id").alias("n_responses"))
    c = filled.agg(
        F.countDistinct("code").alias("n_codes"),
        F.sum((F.col("h") == 1).cast("long") * (F.col("m") == 1).cast("long")).alias("tp"),
        F.sum(((F.col("h") == 0) & (F.col("m") == 1)).cast("long")).alias("fp"),
        F.sum(((F.col("h") == 1) & (F.col("m") == 0)).cast("long")).alias("fn"),
    )
    x = c.crossJoin(n).na.fill(0).withColumn("tn", F.col("n_responses") * F.col("n_codes") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    x = x.withColumn("p", _ratio(tp, tp + fp)).withColumn("r", _ratio(tp, tp + fn))
    x = x.withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    x = x.withColumn("po", _ratio(tp + tn, total)).withColumn("pe", _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), total * total))
    kappa = F.when(total == 0, F.lit(0.0)).when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise((F.col("po") == 1).cast("double"))
    out = [("p", "precision"), ("r", "recall"), ("f", "f1"), ("po", "observed"), ("pe", "expected")]
    return x.select("n_responses", "n_codes", "tp", "fp", "fn", "tn", *[F.round(a, digits).alias(b) for a, b in out], F.round(kappa, digits).alias("kappa"))


def per_code(human: DataFrame, machine: DataFrame, digits: int = 6) -> DataFrame:
    x = cells(human, machine).groupBy("code").agg(
        F.sum("h").alias("human_n"),
        F.sum("m").alias("machine_n"),
        F.sum(F.col("h") * F.col("m")).alias("tp"),
        F.sum((1 - F.col("h")) * F.col("m")).alias("fp"),
        F.sum(F.col("h") * (1 - F.col("m"))).alias("fn"),
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = _ratio(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return x.select("code", "human_n", "machine_n", "tp", "fp", "fn", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"))


def unmatched_codes(own: DataFrame, other: DataFrame) -> DataFrame:
    """(code, n_assignments, n_responses) of codes that the other side never uses."""
    lone = own.join(other.select("code").distinct(), "code", "left_anti")
    return lone.groupBy("code").agg(F.count(F.lit(1)).alias("n_assignments"), F.countDistinct("response_id").alias("n_responses"))


def segment_overlaps(own: DataFrame, other: DataFrame) -> DataFrame:
    """For every row of own (row_id, response_id, code, start, end, segment) its best overlap with a row of other that has
    the same response and code: by spans where both are placed, else by text; 0 without such a row."""
    o = other.select("response_id", "code", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("segment").alias("o_segment"))
    overlap = F.when(F.col("start").isNotNull() & F.col("o_start").isNotNull(), interval_jaccard("start", "end", "o_start", "o_end")).otherwise(string_overlap("segment", "o_segment"))
    scored = own.join(o, ["response_id", "code"], "left").withColumn("overlap", F.when(F.col("o_segment").isNull() & F.col("o_start").isNull(), F.lit(None)).otherwise(overlap))
    return scored.groupBy("row_id").agg(F.coalesce(F.max("overlap"), F.lit(0.0)).alias("overlap"), (F.count("overlap") > 0).alias("shares_code"))


def segment_agreement(human: DataFrame, machine: DataFrame, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """One row: weighted and strict precision, recall and F1 of spans, and right codes in the wrong place."""
    def side(own, other, name):
        s = segment_overlaps(own, other)
        return s.agg(
            F.count(F.lit(1)).alias(f"n_{name}"),
            F.coalesce(F.avg("overlap"), F.lit(0.0)).alias(f"weighted_{name}"),
            F.coalesce(F.avg((F.col("overlap") >= threshold).cast("double")), F.lit(0.0)).alias(f"strict_{name}"),
            F.sum((F.col("shares_code") & (F.col("overlap") < threshold)).cast("long")).alias(f"misplaced_{name}"),
        )

    x = side(machine, human, "machine").crossJoin(side(human, machine, "human"))
    f = lambda kind: _ratio(2 * F.col(f"{kind}_machine") * F.col(f"{kind}_human"), F.col(f"{kind}_machine") + F.col(f"{kind}_human"))
    r = lambda c, name: F.round(c, digits).alias(name)
    return x.select(
        "n_human", "n_machine",
        *[y for kind in ("weighted", "strict") for y in (r(F.col(f"{kind}_machine"), f"{kind}_precision"), r(F.col(f"{kind}_human"), f"{kind}_recall"), r(f(kind), f"{kind}_f1"))],
        F.col("misplaced_machine").alias("right_code_wrong_place"),
    )


def grid(spark, points: list[float]) -> DataFrame:
    return spark.range(len(points)).select(F.element_at(F.array(*[F.lit(float(p)) for p in points]), (F.col("id") + 1).cast("int")).alias("threshold"))


def sweep(units: DataFrame, points: list[float], predict_below: bool, digits: int = 6) -> DataFrame:
    """Confusion, precision, recall and F1 per threshold for units (score, label). Units are counted per interval of the grid
    first, so the grid is crossed with at most as many rows as it has points."""
    spark = units.sparkSession
    edges = F.array(*[F.lit(float(p)) for p in points])
    # thresholds that are at or below the score: all that the comparison needs to know
    passed = F.size(F.filter(edges, lambda p: F.col("score") >= p))
    bins = units.select(passed.alias("passed"), F.col("label").cast("int").alias("label")).groupBy("passed", "label").agg(F.count(F.lit(1)).alias("n"))
    g = spark.range(len(points)).select(F.element_at(edges, (F.col("id") + 1).cast("int")).alias("threshold"), (F.col("id") + 1).alias("rank"))
    at = F.col("passed") >= F.col("rank")
    predicted = ~at if predict_below else at
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    x = F.broadcast(g).join(bins, F.lit(True), "left").groupBy("threshold").agg(
        total(predicted & (F.col("label") == 1)).alias("tp"), total(predicted & (F.col("label") == 0)).alias("fp"),
        total(~predicted & (F.col("label") == 1)).alias("fn"), total(~predicted & (F.col("label") == 0)).alias("tn"),
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = _ratio(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return x.select("threshold", "tp", "fp", "fn", "tn", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"))


def recommend(curve: list[dict], current: float) -> dict:
    """The current threshold if it is among the best by F1, else the middle of the best (the upper one of two); and whether the
    labels have one class only, which makes the choice meaningless."""
    best = max((p["f1"] for p in curve), default=0.0)
    tops = sorted(p["threshold"] for p in curve if abs(p["f1"] - best) <= 1e-9)
    keep = any(abs(t - current) <= 1e-9 for t in tops)
    positives = curve[0]["tp"] + curve[0]["fn"] if curve else 0
    negatives = curve[0]["fp"] + curve[0]["tn"] if curve else 0
    return {"current": current, "recommended": current if keep or not tops else tops[len(tops) // 2], "best_f1": best, "plateau": (tops[0], tops[-1]) if tops else None, "single_class": not positives or not negatives}
