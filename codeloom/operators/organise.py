"""Tag exports: labels to a two-level codebook. pairs: (row, tag, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.names import family_of, sub_of
from codeloom.functions.texts import SPACE, label_tokens, squeeze, trivial_key


def label_counts(pairs: DataFrame) -> DataFrame:
    """(label, count) of pairs with content, 0 for labels that only tag empty ones."""
    full = F.trim(F.coalesce("content", F.lit(""))) != ""
    return pairs.groupBy(F.col("tag").alias("label")).agg(F.sum(full.cast("long")).alias("count"))


def consolidate(counts: DataFrame) -> DataFrame:
    """(label, canonical, rule): spellings that differ in case or white space go to one: without stray white space first, then
    the most frequent, the one with fewest capitals, the first by name; then a first hyphen becomes an underscore where that
    names another label's family."""
    tidy = ~F.col("label").rlike(SPACE)
    capitals = F.length(F.regexp_replace("label", r"[^\p{Lu}]", ""))
    rank = F.struct(~tidy, -F.col("count"), capitals, F.col("label"))
    winners = counts.groupBy(trivial_key("label").alias("key")).agg(F.min_by("label", rank).alias("winner"))
    one = counts.withColumn("key", trivial_key("label")).join(winners, "key")
    stage = one.select(F.col("winner").alias("name")).distinct()
    known = stage.select(family_of("name").alias("family"), F.col("name").alias("member"))
    other = stage.where(F.instr("name", "-") > 0).withColumn("alternative", F.expr("concat(substring_index(name, '-', 1), '_', substring(name, instr(name, '-') + 1))")).withColumn("family", family_of("alternative"))
    moved = other.join(known, "family").where("member <> name").select("name", "alternative").distinct()
    x = one.join(moved, one["winner"] == moved["name"], "left")
    squash = lambda c: F.regexp_replace(c, SPACE, "")
    rules = F.array(
        F.when((F.col("label") != F.col("winner")) & (squash("label") != squash("winner")), F.lit("case")),
        F.when((F.col("label") != F.col("winner")) & (F.lower("label") != F.lower("winner")), F.lit("whitespace")),
        F.when(F.col("alternative").isNotNull(), F.lit("family_separator")),
    )
    return x.select("label", F.coalesce("alternative", "winner").alias("canonical"), F.array_join(rules, "+").alias("rule"))


def tree(counts: DataFrame) -> DataFrame:
    """(family, name, sub, count, family_count, place): leaves under their family, families and leaves by count, then name."""
    x = counts.select(F.col("label").alias("name"), family_of("label").alias("family"), sub_of("label").alias("sub"), "count")
    total = F.sum("count").over(Window.partitionBy("family"))
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("count"), "name"))
    return x.withColumn("family_count", total).withColumn("place", place)


def examples(segments: DataFrame) -> DataFrame:
    """(code, segment, rank): the two longest different segments of a code, ties by text. segments: (row, code, segment)."""
    distinct = segments.withColumn("key", squeeze("segment")).where("key <> ''").groupBy("code", "key").agg(F.min_by("segment", "row").alias("segment"))
    w = Window.partitionBy("code").orderBy(F.desc(F.length("key")), "key")
    return distinct.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("code", "segment", "rank")


def structure_notes(counts: DataFrame) -> DataFrame:
    """(category, subject): shared sub-names, leaves with one segment, bare families beside structured ones, families tagged
    directly, sub-names with a hyphen."""
    x = counts.select(F.col("label").alias("name"), family_of("label").alias("family"), sub_of("label").alias("sub"), "count")
    has_subs = x.where("sub <> ''").select("family").distinct()
    note = lambda rows, category, subject: rows.select(F.lit(category).alias("category"), F.col(subject).alias("subject"))
    shared = x.where("sub <> ''").groupBy("sub").agg(F.countDistinct("family").alias("n")).where("n > 1")
    bare = x.where("sub = ''")
    return (
        note(shared, "shared_subcode", "sub")
        .union(note(x.where("sub <> '' and count = 1"), "single_segment_leaf", "name"))
        .union(note(x.where(F.instr("sub", "-") > 0), "multi_hyphen_subcode", "name"))
        .union(note(bare.join(has_subs, "family", "left_anti"), "bare_top_level_code", "name"))
        .union(note(bare.where("count > 0").join(has_subs, "family", "left_semi"), "family_with_own_segments", "name"))
    )


def near_misses(labels: DataFrame, limit: int = 2, least: int = 5) -> DataFrame:
    """(label_a, label_b, distance) of different labels within an edit distance. Labels can only be that near if some of the
    label with up to `limit` letters left out is the same, so they meet on a hash of such remains, not all with all."""
    x = labels.select("label").distinct().where(F.length("label") >= least)
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))
    keys = x.select("label", F.array_distinct(F.concat(F.array("label"), cut(F.col("label")))).alias("r"))
    for _ in range(limit - 1):
        keys = keys.select("label", F.array_distinct(F.concat("r", F.flatten(F.transform("r", cut)))).alias("r"))
    keyed = keys.select("label", F.explode(F.transform("r", lambda v: F.xxhash64(v))).alias("key"))
    pairs = keyed.select(F.col("label").alias("label_a"), "key").join(keyed.select(F.col("label").alias("label_b"), "key"), "key").where("label_a < label_b").select("label_a", "label_b").distinct()
    d = F.levenshtein("label_a", "label_b", limit)
    return pairs.withColumn("distance", d).where(F.col("distance").between(0, limit))


def shared_segments(segments: DataFrame, limit: int = 2) -> DataFrame:
    """(segment, n_codes, over_limit) of segments that carry several codes."""
    x = segments.withColumn("key", squeeze("segment")).where("key <> ''").groupBy("key").agg(F.countDistinct("code").alias("n_codes")).where("n_codes > 1")
    return x.select(F.col("key").alias("segment"), "n_codes", (F.col("n_codes") > limit).alias("over_limit"))


def label_suggestion(members: DataFrame) -> DataFrame:
    """(group, label): the three most frequent name tokens of a group's members (group, name), ties by token."""
    t = members.select("group", F.explode(label_tokens("name")).alias("token")).groupBy("group", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("group").orderBy(F.desc("n"), "token")
    top = t.withColumn("k", F.row_number().over(w)).where("k <= 3")
    return top.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda v: v["token"]), " ").alias("label"))


def to_codebook(tree_rows: DataFrame) -> DataFrame:
    """Codes (code_id, name, parent_id) of a tree: families and their leaves."""
    from codeloom.functions.names import code_id

    tops = tree_rows.select(F.col("family").alias("name")).distinct().select(code_id("name").alias("code_id"), "name", F.lit(None).cast("string").alias("parent_id"))
    subs = tree_rows.where("sub <> ''").select(code_id("name").alias("code_id"), "name", code_id("family").alias("parent_id"))
    return tops.unionByName(subs)


def attach_definitions(codes: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes with descriptions (name, description) joined on, and what is on one side only: (name, side)."""
    joined = codes.drop("description").join(definitions.select("name", "description"), "name", "left")
    lone = definitions.select("name").join(codes.select("name"), "name", "left_anti").withColumn("side", F.lit("defined_not_tagged"))
    return joined, lone.union(codes.select("name").join(definitions.select("name"), "name", "left_anti").withColumn("side", F.lit("tagged_not_defined")))
