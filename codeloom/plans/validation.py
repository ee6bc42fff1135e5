"""Two codings or two codebooks side by side: vocabularies matched, cells and segments compared, thresholds swept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import CodingRules
from codeloom.functions import udfs
from codeloom.functions.names import code_text, family_of
from codeloom.functions.texts import cosine
from codeloom.operators import agreement, similarity

GRID = [round(0.05 * k, 2) for k in range(21)]


def vectors(codes: DataFrame) -> DataFrame:
    """(name, vector) of codes (name, description)."""
    return codes.select("name", udfs.lexical_vector(codes.sparkSession)(code_text("name", "description")).alias("vector")).dropDuplicates(["name"])


def match_codes(left: DataFrame, right: DataFrame, tau_high: float = 0.8) -> DataFrame:
    """(name_a, name_b, score, band) of two vocabularies (name, description) by optimal assignment; accepted from tau_high on."""
    one = lambda x: vectors(x).withColumn("pair", F.lit(0))
    return similarity.match(one(left), one(right), "pair", tau_high, tau_high).drop("pair")


def compare_codebooks(left: DataFrame, right: DataFrame, rules: CodingRules = CodingRules()) -> tuple[DataFrame, float]:
    """The matching and the share of agreed pairs in the larger codebook."""
    one = lambda x: vectors(x).withColumn("pair", F.lit(0))
    matched = similarity.match(one(left), one(right), "pair", rules.tau_high, rules.tau_low, dissolve=False)
    return matched.drop("pair"), similarity.agreement_rate(matched, "pair").first()["rate"]


def canonical(machine: DataFrame, matching: DataFrame) -> DataFrame:
    """Machine assignments with accepted codes under their human name."""
    accepted = matching.where("band = 'agreed'").select(F.col("name_b").alias("code"), F.col("name_a").alias("human_code"))
    return machine.join(F.broadcast(accepted), "code", "left").withColumn("code", F.coalesce("human_code", "code")).drop("human_code")


def concurrent_validation(human: DataFrame, machine: DataFrame, descriptions: DataFrame | None = None, rules: CodingRules = CodingRules()) -> dict[str, DataFrame]:
    """Assignments (response_id, code, ...) of both sides: matching, cells of all codes and of matched ones, lists of what only
    one side uses with its nearest code on the other."""
    spark = human.sparkSession
    words = descriptions if descriptions is not None else spark.createDataFrame([], "name string, description string")
    side = lambda x: x.select(F.col("code").alias("name")).distinct().join(words, "name", "left").na.fill("", ["description"])
    matching = match_codes(side(human), side(machine), rules.tau_high)
    renamed = canonical(machine, matching)
    shared = matching.where("band = 'agreed'").select(F.col("name_a").alias("code"))
    only = lambda x: x.join(F.broadcast(shared), "code", "left_semi")
    near = similarity.nearest(vectors(side(machine)), vectors(side(human)))
    return {
        "matching": matching,
        "code_level": agreement.scores(human, renamed),
        "matched_only": agreement.scores(only(human), only(renamed)),
        "per_code": agreement.per_code(human, renamed),
        "over_coding": agreement.unmatched_codes(renamed, human).join(near, F.col("code") == F.col("name"), "left").drop("name"),
        "blind_spots": agreement.unmatched_codes(human, renamed),
    }


def family_rollup(mapping: DataFrame) -> DataFrame:
    """(family, other_family, n) of a mapping (name, target): where the leaves of a family go; null for nowhere."""
    return mapping.groupBy(family_of("name").alias("family"), family_of("target").alias("other_family")).agg(F.count(F.lit(1)).alias("n"))


def crosswalk(source: DataFrame, target: DataFrame, rules: CodingRules = CodingRules(), names_only: bool = False) -> dict[str, DataFrame]:
    """Leaves of one codebook onto another: assignment, nearest, band per leaf, and the roll-up by family."""
    if names_only:
        source, target = (x.withColumn("description", F.lit("")) for x in (source, target))
    near = similarity.nearest(vectors(source), vectors(target))
    band = F.when(F.col("score") >= rules.tau_high, "same").when(F.col("score") >= rules.tau_low, "grey").otherwise("unmapped")
    mapping = near.withColumn("band", band).withColumn("target", F.when(F.col("band") != "unmapped", F.col("nearest")))
    return {"matching": compare_codebooks(source, target, rules)[0], "mapping": mapping, "rollup": family_rollup(mapping)}


def calibrate(human: DataFrame, machine: DataFrame, rules: CodingRules = CodingRules()) -> dict[str, dict]:
    """Sweeps of tau_fit (an assignment's segment against its code; unsupported if the human never applied the code there) and
    of tau_high and tau_low (a machine code's best human code; known if the human uses the name). Single-class labels are
    reported, since the best threshold then means nothing."""
    spark = human.sparkSession
    v = udfs.lexical_vector(spark)
    cell = human.select("response_id", "code").distinct().withColumn("known", F.lit(True))
    fit = machine.join(cell, ["response_id", "code"], "left").select(cosine(v("code"), v(F.coalesce("segment", F.lit("")))).alias("score"), F.col("known").isNull().alias("label"))
    name = lambda x: x.select(F.col("code").alias("name")).distinct().withColumn("description", F.lit(""))
    near = similarity.nearest(vectors(name(machine)), vectors(name(human)))
    route = near.join(name(human).select("name", F.lit(True).alias("known")), "name", "left").select("score", F.col("known").isNotNull().alias("label"))
    sweep = lambda units, below: [r.asDict() for r in agreement.sweep(units, GRID, below).orderBy("threshold").collect()]
    told = {"tau_fit": agreement.recommend(sweep(fit, True), rules.tau_fit), "tau_high": agreement.recommend(sweep(route, False), rules.tau_high), "tau_low": agreement.recommend(sweep(route.withColumn("label", ~F.col("label")), True), rules.tau_low)}
    if told["tau_low"]["recommended"] > told["tau_high"]["recommended"]:
        told["tau_low"]["recommended"] = told["tau_high"]["recommended"]
    return told
