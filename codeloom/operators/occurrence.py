"""The occurrence relation (response_id, code) and what is counted over it.

An occurrence is kept in long form, one row per response and code; the dense matrix exists only as an export. Self-joins
run on the response, so their size is bounded by the codes of a response, not by the number of responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.names import family_of


def occurrence(assignments: DataFrame) -> DataFrame:
    """Distinct (response_id, code)."""
    return assignments.select("response_id", "code").where("response_id is not null and code is not null").distinct()


def build_matrix(responses: DataFrame, assignments: DataFrame) -> DataFrame:
    """The responses' universe with their codes; a response without codes keeps one row with a null code."""
    return responses.select("response_id").distinct().join(occurrence(assignments), "response_id", "left")


def unknown_responses(responses: DataFrame, assignments: DataFrame) -> DataFrame:
    """Coded response ids that are not in the universe; a matrix needs this to be empty."""
    return assignments.select("response_id").distinct().join(responses.select("response_id"), "response_id", "left_anti")


def dense(occ: DataFrame, codes: list[str]) -> DataFrame:
    """The binary matrix in wide form, for export of a known vocabulary only."""
    return occ.groupBy("response_id").pivot("code", codes).agg(F.max(F.lit(1))).na.fill(0)


def frequencies(occ: DataFrame) -> DataFrame:
    """Responses per code."""
    return occ.groupBy("code").agg(F.count(F.lit(1)).alias("n_responses"))


def codes_per_response(occ: DataFrame) -> DataFrame:
    return occ.groupBy("response_id").agg(F.count(F.lit(1)).alias("n_codes"))


def fraction_threshold(fraction: float, n: Column) -> Column:
    """Least count that is not below the fraction, with a tolerance for binary fractions."""
    return F.greatest(F.lit(0), F.ceil(F.lit(fraction) * n - F.lit(1e-9))) if fraction > 0 else F.lit(0)


def frequency_filter(occ: DataFrame, least: int = 2, fraction: float | None = None) -> DataFrame:
    """(code, n_responses, threshold, kept, reason) of every code; reason says which rule drops it."""
    n = occ.agg(F.countDistinct("response_id").alias("universe"))
    both = frequencies(occ).crossJoin(F.broadcast(n))  # one row
    part = fraction_threshold(fraction or 0.0, F.col("universe"))
    threshold = F.greatest(F.lit(least), part).cast("long")
    reason = F.when(F.col("n_responses") >= threshold, F.lit("")).when(F.col("n_responses") < least, F.lit("absolute")).otherwise(F.lit("fraction"))
    return both.select("code", "n_responses", threshold.alias("threshold"), (F.col("n_responses") >= threshold).alias("kept"), reason.alias("reason"))


def filtered(occ: DataFrame, least: int = 2, fraction: float | None = None) -> DataFrame:
    return occ.join(frequency_filter(occ, least, fraction).where("kept").select("code"), "code", "left_semi")


def family_occurrence(occ: DataFrame) -> DataFrame:
    """(response_id, code) over families: a family occurs where any of its codes does."""
    return occ.select("response_id", family_of("code").alias("code")).distinct()


def cooccurrence(occ: DataFrame) -> DataFrame:
    """(code_a, code_b, n_both, jaccard) with code_a <= code_b; a code with itself has 1."""
    f = frequencies(occ)
    a, b = occ.select("response_id", F.col("code").alias("code_a")), occ.select("response_id", F.col("code").alias("code_b"))
    pairs = a.join(b, "response_id").where("code_a <= code_b").groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = pairs.join(f.select(F.col("code").alias("code_a"), F.col("n_responses").alias("n_a")), "code_a").join(f.select(F.col("code").alias("code_b"), F.col("n_responses").alias("n_b")), "code_b")
    jaccard = F.when(F.col("code_a") == F.col("code_b"), F.lit(1.0)).otherwise(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))
    return pairs.select("code_a", "code_b", "n_both", jaccard.alias("jaccard"))


def frequent_pairs(occ: DataFrame, min_support: int = 2) -> DataFrame:
    """(code_a, code_b, support, share, lift) of pairs in at least min_support responses."""
    n = occ.agg(F.countDistinct("response_id").alias("n"))
    f = frequencies(occ)
    # a code of a frequent pair is frequent itself: the rest need not be joined
    frequent = occ.join(f.where(F.col("n_responses") >= min_support).select("code"), "code", "left_semi")
    a, b = frequent.select("response_id", F.col("code").alias("code_a")), frequent.select("response_id", F.col("code").alias("code_b"))
    pairs = a.join(b, "response_id").where("code_a < code_b").groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    pairs = pairs.join(f.select(F.col("code").alias("code_a"), F.col("n_responses").alias("n_a")), "code_a").join(f.select(F.col("code").alias("code_b"), F.col("n_responses").alias("n_b")), "code_b")
    share = F.col("support") / F.col("n")
    return pairs.crossJoin(F.broadcast(n)).select("code_a", "code_b", "support", share.alias("share"), (share / ((F.col("n_a") / F.col("n")) * (F.col("n_b") / F.col("n")))).alias("lift"))


def frequent_triples(occ: DataFrame, min_support: int = 2, most: int = 20_000) -> DataFrame:
    """(code_a, code_b, code_c, support, share, lift): triples all of whose pairs are frequent, the `most` with the largest
    bound (the least support of their pairs, ties by name) counted, those in at least min_support responses kept."""
    pairs = frequent_pairs(occ, min_support).select("code_a", "code_b", "support")
    ab = pairs.select("code_a", "code_b", F.col("support").alias("s_ab"))
    ac = pairs.select("code_a", F.col("code_b").alias("code_c"), F.col("support").alias("s_ac"))
    bc = pairs.select(F.col("code_a").alias("code_b"), F.col("code_b").alias("code_c"), F.col("support").alias("s_bc"))
    ranked = ab.join(ac, "code_a").where("code_b < code_c").join(bc, ["code_b", "code_c"]).withColumn("bound", F.least("s_ab", "s_ac", "s_bc"))
    # the limit is the feature: the rows are what gets counted
    chosen = ranked.orderBy(F.desc("bound"), "code_a", "code_b", "code_c").limit(most).select("code_a", "code_b", "code_c")
    # the triples of a response are few beside those of a code's responses, and `most` bounds what is broadcast
    has = lambda c: occ.select("response_id", F.col("code").alias(c))
    both = has("code_a").join(has("code_b"), "response_id").join(F.broadcast(chosen.select("code_a", "code_b").distinct()), ["code_a", "code_b"])
    three = both.join(has("code_c"), "response_id").where("code_b < code_c").join(F.broadcast(chosen), ["code_a", "code_b", "code_c"])
    counted = three.groupBy("code_a", "code_b", "code_c").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    f, n = frequencies(occ), occ.agg(F.countDistinct("response_id").alias("n"))
    for c in "abc":
        counted = counted.join(f.select(F.col("code").alias(f"code_{c}"), F.col("n_responses").alias(f"n_{c}")), f"code_{c}")
    share = F.col("support") / F.col("n")
    chance = (F.col("n_a") / F.col("n")) * (F.col("n_b") / F.col("n")) * (F.col("n_c") / F.col("n"))
    return counted.crossJoin(F.broadcast(n)).select("code_a", "code_b", "code_c", "support", share.alias("share"), (share / chance).alias("lift"))


def all_frequent_triples(occ: DataFrame, min_support: int = 2) -> DataFrame:
    """(code_a, code_b, code_c, support) of every triple in at least min_support responses, none left out. Only pairs that are
    frequent themselves are carried to the third code; the work grows with the triples of a response."""
    pairs = frequent_pairs(occ, min_support).select("code_a", "code_b")
    has = lambda c: occ.select("response_id", F.col("code").alias(c))
    two = has("code_a").join(has("code_b"), "response_id").where("code_a < code_b").join(pairs, ["code_a", "code_b"], "left_semi")
    three = two.join(has("code_c"), "response_id").where("code_b < code_c")
    return three.groupBy("code_a", "code_b", "code_c").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)


def signatures(occ: DataFrame) -> DataFrame:
    """(response_id, signature): the sorted families that a response touches."""
    return family_occurrence(occ).groupBy("response_id").agg(F.array_join(F.array_sort(F.collect_list("code")), "|").alias("signature"))


def signature_groups(occ: DataFrame, least: int = 2) -> DataFrame:
    """(signature, size, first_response) of signatures that at least `least` responses share. Members stay in long form
    (signatures()): a group may hold a third of all responses."""
    return signatures(occ).groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.min("response_id").alias("first_response")).where(F.col("size") >= least)


def singletons(occ: DataFrame) -> DataFrame:
    return signatures(occ).groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.min("response_id").alias("response_id")).where("size = 1").select("response_id", "signature")


def nearest_mates(occ: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """(response_id, mate, jaccard, rank): the k responses with the most similar code sets; ties by id. Only responses that
    share a code are compared; with `queries` (response_id), mates are searched for those alone, among all."""
    sizes = codes_per_response(occ)
    asked = occ if queries is None else occ.join(queries.select("response_id").distinct(), "response_id", "left_semi")
    a, b = asked.select(F.col("response_id"), "code"), occ.select(F.col("response_id").alias("mate"), "code")
    both = a.join(b, "code").where("response_id <> mate").groupBy("response_id", "mate").agg(F.count(F.lit(1)).alias("n_both"))
    sized = both.join(sizes, "response_id").join(sizes.select(F.col("response_id").alias("mate"), F.col("n_codes").alias("m_codes")), "mate")
    scored = sized.select("response_id", "mate", (F.col("n_both") / (F.col("n_codes") + F.col("m_codes") - F.col("n_both"))).alias("jaccard"))
    w = Window.partitionBy("response_id").orderBy(F.desc("jaccard"), "mate")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def metadata_crosstab(labels: DataFrame, meta: DataFrame, missing: str = "(missing)") -> DataFrame:
    """(cluster, value, n) of labels (response_id, cluster) by meta (response_id, value)."""
    return labels.join(meta, "response_id", "left").groupBy("cluster", F.coalesce("value", F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def metadata_keys(meta: DataFrame) -> DataFrame:
    """Every key of a map column `meta`."""
    return meta.select(F.explode(F.map_keys("meta")).alias("key")).distinct()


def cluster_means(occ: DataFrame, labels: DataFrame, highlight: float = 0.4) -> DataFrame:
    """(cluster, code, n, mean, prominent) over the grid of clusters and codes."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    grid = sizes.crossJoin(F.broadcast(occ.select("code").distinct()))
    hits = labels.join(occ, "response_id").groupBy("cluster", "code").agg(F.count(F.lit(1)).alias("n"))
    mean = F.coalesce(F.col("n"), F.lit(0)) / F.col("size")
    return grid.join(hits, ["cluster", "code"], "left").select("cluster", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"), mean.alias("mean"), (mean >= highlight).alias("prominent"))
