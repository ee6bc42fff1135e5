"""Codebooks: tables codes (code_id, name, description, parent_id) and evidence (code_id, response_id, quote, verified)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.names import family_of, grammar_reasons, sub_of

FINDING = ["check_id", "severity", "scope", "subject", "message", "data"]


def leaves(codes: DataFrame) -> DataFrame:
    """Codes that are no code's parent."""
    return codes.join(codes.select(F.col("parent_id").alias("code_id")).where("code_id is not null").distinct(), "code_id", "left_anti")


def sorted_codes(codes: DataFrame) -> DataFrame:
    return codes.orderBy("name", "code_id")


def children_of(codes: DataFrame, parent_id: str) -> DataFrame:
    return codes.where(F.col("parent_id") == parent_id)


def families(codes: DataFrame) -> DataFrame:
    """(family, size, members) with members in order. A codebook's family is bounded by the codebook."""
    return codes.groupBy(family_of("name").alias("family")).agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("members"))


def skeleton(codes: DataFrame) -> DataFrame:
    """(family, subs): the sub-names under each family, in order."""
    subs = codes.select(family_of("name").alias("family"), sub_of("name").alias("sub"))
    return subs.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("sub") != "", F.col("sub")))), "|").alias("subs"))


def assignments_of(evidence: DataFrame, codes: DataFrame) -> DataFrame:
    """Verified evidence as assignment rows."""
    return evidence.where("verified").join(codes.select("code_id", F.col("name").alias("code")), "code_id").select("response_id", F.col("quote").alias("segment"), "code")


def usage(evidence: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct responses with verified evidence per code, 0 for codes without."""
    used = evidence.where("verified").groupBy("code_id").agg(F.countDistinct("response_id").alias("n"))
    return codes.join(used, "code_id", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n_responses"))


def cross_family_subs(codes: DataFrame) -> DataFrame:
    x = codes.select(family_of("name").alias("family"), sub_of("name").alias("sub")).where("sub <> ''")
    return x.groupBy("sub").agg(F.countDistinct("family").alias("n_families"), F.array_join(F.array_sort(F.collect_set("family")), "|").alias("families")).where("n_families >= 2")


def chains(codes: DataFrame, most: int = 20) -> DataFrame:
    """(code_id, depth, cyclic): levels up to the root, and whether the parents form a circle. Pointers are doubled in
    each step, so depths up to 2 ** steps are exact and every chain that is still open by then runs in a circle."""
    known = codes.select(F.col("code_id"), F.col("parent_id").alias("up"))
    ids = codes.select(F.col("code_id").alias("up"))
    # a parent that does not exist ends the chain
    at = known.join(ids.withColumn("there", F.lit(True)), "up", "left").select("code_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("steps"))
    kept = bool(codes.sparkSession.sparkContext.getCheckpointDir())
    for _ in range(max(1, most.bit_length())):
        at = at.checkpoint() if kept else at.persist()  # each step reads the last one twice
        jump = at.select(F.col("code_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        at = at.join(jump, "up", "left").select("code_id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
    return at.select("code_id", F.when(F.col("up").isNull(), F.col("steps") + 1).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def _finding(rows: DataFrame, check: str, severity: str, scope: str, subject: Column, message: Column, **data: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), subject.alias("subject"), message.alias("message"), F.to_json(F.struct(*[v.alias(k) for k, v in data.items()])).alias("data"))


def check_codebook(codes: DataFrame, evidence: DataFrame, corpus_ids: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """S6 findings: duplicate names, missing parents, circles, depth, evidence on parents, missing descriptions, evidence from
    unknown responses, name grammar of leaves."""
    name = F.col("name")
    mark = lambda m: F.lit(m)
    twice = codes.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n > 1")
    out = [_finding(twice, "S6", "ERROR", "codebook", name, F.concat(F.col("n").cast("string"), F.lit(" codes share one name")), marker=mark("duplicate_name"), n=F.col("n"))]
    has_parent = codes.where("parent_id is not null")
    orphan = has_parent.join(codes.select(F.col("code_id").alias("parent_id")), "parent_id", "left_anti")
    out.append(_finding(orphan, "S6", "ERROR", "codebook", name, F.lit("the parent does not exist"), marker=mark("orphan_parent"), parent_id=F.col("parent_id")))
    deep = codes.join(chains(codes), "code_id")
    out.append(_finding(deep.where("cyclic"), "S6", "ERROR", "codebook", name, F.lit("the parents form a circle"), marker=mark("parent_cycle")))
    out.append(_finding(deep.where(F.col("depth") > depth), "S6", "WARN", "codebook", name, F.lit("the code sits too deep"), marker=mark("hierarchy_too_deep"), depth=F.col("depth")))
    cited = evidence.groupBy("code_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    parents = codes.join(codes.select(F.col("parent_id").alias("code_id")).where("code_id is not null").distinct(), "code_id", "left_semi")
    out.append(_finding(parents.join(cited, "code_id"), "S6", "INFO", "codebook", name, F.lit("evidence belongs at the leaves"), marker=mark("evidence_on_parent"), n=F.col("n_evidence")))
    out.append(_finding(codes.where(F.trim(F.coalesce("description", F.lit(""))) == ""), "S6", "WARN", "codebook", name, F.lit("the code has no description"), marker=mark("missing_description")))
    if corpus_ids is not None:
        lost = evidence.join(corpus_ids.select("response_id").distinct(), "response_id", "left_anti").groupBy("code_id").agg(F.countDistinct("response_id").alias("n")).join(codes, "code_id")
        out.append(_finding(lost, "S6", "ERROR", "codebook", name, F.lit("evidence names responses that the corpus lacks"), marker=mark("evidence_response_missing"), n=F.col("n")))
    odd = leaves(codes).withColumn("reasons", grammar_reasons("name")).where(F.size("reasons") > 0)
    out.append(_finding(odd, "S6", "WARN", "codebook", name, F.lit("the name breaks the grammar"), marker=mark("name_grammar"), reasons=F.array_join("reasons", ",")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def gini(sizes: DataFrame, column: str = "size") -> DataFrame:
    """One row: the Gini coefficient of a column of counts, 6 digits. Ranks come from counts of equal values, so the sort is
    over distinct values."""
    by_value = sizes.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ranks below + 1 .. below + c
    weighted = F.col("v") * (F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2)
    x = by_value.withColumn("below", below).agg(F.sum(weighted).alias("w"), F.sum(F.col("v") * F.col("c")).alias("t"), F.sum("c").alias("n"))
    return x.select(F.when((F.col("n") > 1) & (F.col("t") > 0), F.round(2 * F.col("w") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"), 6)).otherwise(F.lit(0.0)).alias("gini"))


def evidence_distribution(codes: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: verified evidence per code as count, total, mean, median, least, most, quartiles, codes without."""
    n = codes.join(evidence.where("verified").groupBy("code_id").agg(F.count(F.lit(1)).alias("k")), "code_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    q = lambda p: F.round(F.percentile("k", F.lit(p)), 6)
    return n.agg(F.count(F.lit(1)).alias("n_codes"), F.sum("k").alias("total"), F.round(F.avg("k"), 6).alias("mean"), q(0.5).alias("median"), F.min("k").alias("minimum"), F.max("k").alias("maximum"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.sum((F.col("k") == 0).cast("long")).alias("zero_evidence_codes"))


def health(codes: DataFrame, evidence: DataFrame, previous: DataFrame | None = None, near_duplicates: DataFrame | None = None) -> DataFrame:
    """One row of codebook health."""
    size = families(codes)
    orphans = codes.where("parent_id is not null").join(codes.select(F.col("code_id").alias("parent_id")), "parent_id", "left_anti")
    one = codes.agg(F.count(F.lit(1)).alias("n_codes"))
    parts = [
        size.agg(F.count(F.lit(1)).alias("n_families"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")),
        leaves(codes).agg(F.count(F.lit(1)).alias("n_leaves")),
        orphans.agg(F.count(F.lit(1)).alias("n_orphans")),
        gini(size).withColumnRenamed("gini", "family_balance_gini"),
        evidence_distribution(codes, evidence).select("total", "median", "zero_evidence_codes"),
        (previous if previous is not None else codes.where("false")).agg(F.countDistinct("name").alias("previous_n_codes")),
        (codes.join(previous.select("name").distinct(), "name", "left_anti") if previous is not None else codes).agg(F.count(F.lit(1)).alias("new_codes")),
    ]
    if near_duplicates is not None:
        parts.append(near_duplicates.agg(F.count(F.lit(1)).alias("near_duplicate_pairs")))
    for p in parts:
        one = one.crossJoin(p)  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    growth = F.when(F.col("previous_n_codes") > 0, F.round(F.col("new_codes") / F.col("previous_n_codes"), 6)).otherwise((F.col("n_codes") > 0).cast("double"))
    return one.withColumns({"n_parents": F.col("n_codes") - F.col("n_leaves"), "leaf_ratio": ratio("n_leaves", "n_codes"), "orphan_ratio": ratio("n_orphans", "n_codes"), "largest_family_share": ratio("largest", "n_codes"), "growth_rate": growth}).drop("largest")


def checkpoint_signals(row: dict, policy, responses_coded: int, since: int, spiked: bool = False) -> dict:
    """What a health row says under a checkpoint policy."""
    near, new = row["near_duplicate_pairs"] > policy.max_near_duplicate_pairs, row["new_codes"] > policy.max_new_codes_per_batch
    spacing, floor = since >= policy.min_responses_between_checkpoints, since >= policy.hard_floor_responses
    event = (near or new or spiked) and spacing and policy.mode == "event_driven"
    return {"near_duplicates_exceeded": near, "new_codes_exceeded": new, "spike_detected": spiked, "spacing_satisfied": spacing, "hard_floor_reached": floor, "responses_coded": responses_coded, "recommend_checkpoint": event or floor}


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): names added and removed between two snapshots."""
    added = after.select("name").distinct().join(before.select("name"), "name", "left_anti").withColumn("change", F.lit("added"))
    removed = before.select("name").distinct().join(after.select("name"), "name", "left_anti").withColumn("change", F.lit("removed"))
    return added.union(removed)


def merge_evidence(*tables: DataFrame) -> DataFrame:
    """Union of evidence (response_id, start, end, quote), each once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["response_id", "start", "end", "quote"])


def evidence_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (response_id, quote, n_before, n_after, problem) whose number differs: lost, invented or multiplied."""
    count = lambda t, c: t.groupBy("response_id", "quote").agg(F.count(F.lit(1)).alias(c))
    x = count(before, "n_before").join(count(after, "n_after"), ["response_id", "quote"], "full").na.fill(0, ["n_before", "n_after"])
    problem = F.when(F.col("n_before") == 0, F.lit("invented")).when(F.col("n_after") < F.col("n_before"), F.lit("lost")).otherwise(F.lit("multiplied"))
    return x.where("n_before <> n_after").withColumn("problem", problem)
