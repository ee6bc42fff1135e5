"""The model's relations read out of the star-schema tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as responses, event type and its number as code."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(k.isNotNull()).select(F.col("user_id").alias("response_id"), F.concat("event_type", F.lit("-k"), k).alias("code"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as responses, brand and type of their parts as code."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("-"), "p_type").alias("code"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").select(F.col("l_orderkey").alias("response_id"), "code")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.col("text").alias("content"), "source")


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as families and their types as leaves. The smallest size decides what is wrong with a leaf: 1 puts a blank into
    the name, below 3 the description is missing; brands 23 and up have no parent code."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    leaf = table(spark, sf_dir, "part").groupBy(brand.alias("b"), F.lower("p_type").alias("t")).agg(F.min("p_size").alias("s"), F.min("p_name").alias("d"))
    number = F.substring("b", 6, 9).cast("int")
    leaves = leaf.select(
        F.concat(F.lit("c-"), "b", F.lit("-"), "t").alias("code_id"),
        F.concat("b", F.lit("-"), "t", F.when(F.col("s") == 1, F.lit(" x")).otherwise(F.lit(""))).alias("name"),
        F.when(F.col("s") < 3, F.lit("")).otherwise(F.col("d")).alias("description"),
        F.concat(F.lit("p-"), "b").alias("parent_id"),
    )
    tops = leaf.where(number < 23).select("b").distinct().select(F.concat(F.lit("p-"), "b").alias("code_id"), F.col("b").alias("name"), F.lit("a brand").alias("description"), F.lit(None).cast("string").alias("parent_id"))
    return leaves.unionByName(tops)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evidence for their part's leaf, or for the brand where it is an order's seventh line."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("b"), F.lower("p_type").alias("t"), "p_name")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(part, "l_partkey")
    code = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("p-"), "b")).otherwise(F.concat(F.lit("c-"), "b", F.lit("-"), "t"))
    return x.select(code.alias("code_id"), F.col("l_orderkey").alias("response_id"), F.col("p_name").alias("quote"), (F.col("l_returnflag") != "N").alias("verified"))


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels")
    return x.where("quality = 1").select(F.col("doc_id").alias("response_id"), F.lit("quality-good").alias("code")).union(x.where("toxic = 1").select("doc_id", F.lit("tone-toxic")))


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule coder: long texts are good, texts with an exclamation mark toxic, texts with a bar are tables."""
    x = table(spark, sf_dir, "documents")
    rule = lambda c, name: x.where(c).select(F.col("doc_id").alias("response_id"), F.lit(name).alias("code"))
    return rule(F.length("text") >= 200, "quality-good").union(rule(F.instr("text", "!") > 0, "tone-toxic")).union(rule(F.instr("text", "|") > 0, "form-table"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log: a run per user, kinds of events as markers."""
    kinds = {"signup": "response_prepared", "purchase": "checkpoint_evaluated", "error": "judge_consulted", "click": "code_created", "view": "code_merged"}
    event = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{"batch": '), k, F.lit(', "response_id": '), k, F.lit("}"))
    subject = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).otherwise(F.concat(F.lit("code-"), k))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", event.alias("event"), subject.alias("subject"), payload.alias("payload"))


def spans(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Order lines with one return flag as placed segments of an order, coded by line status."""
    x = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    start = F.col("l_linenumber") * 10
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_orderkey").alias("response_id"), F.col("l_linestatus").alias("code"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("segment"))
