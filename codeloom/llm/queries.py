"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, extraction, language, packing, quality, sharding, simhash, suffix_dedup, toxicity, url_rules
from codeloom.llm.common import arrow_rows, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    """crc32 of the document id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: The rules of the contract: verdict, host, path.
GIVEN_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bad = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).na.drop()
    mined = url_rules.mine(pages.select(F.col("page_id").alias("id"), "url"), bad)
    return url_rules.judge(pages, GIVEN_RULES, mined)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hashlib import sha256

    def each(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "n_passage_bytes")}
        for text, spans, passages in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data = (text.as_py() or "").encode()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
            out["n_spans"].append(len(spans))
            left = suffix_dedup.kept(data, spans)
            out["kept_sha256"].append(sha256(left).hexdigest())
            out["text"].append(left.decode("utf-8", "ignore"))  # without what is left of cut characters
            # passages of over 50 words that come again are told of beside the strings of 400 bytes; those under 400 bytes stay in the text
            out["n_passages"].append(len(passages))
            out["n_passage_bytes"].append(sum(s["end"] - s["start"] for s in passages))
        return {"doc_id": batch.column(0)} | out

    spans = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_passages long, n_passage_bytes long"
    return arrow_rows(spans, ["doc_id", "text", "spans", "passages"], schema, each)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), "doc_id", sharding.shard_names())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, remainder(5) != 0)
    return language.predict(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_extraction": op2_extraction,
    "op3_url_rules": op3_url_rules,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {}
