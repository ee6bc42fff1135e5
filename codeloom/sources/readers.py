"""Corpora, codings and codebooks from files. Paths are Spark paths: local, shared or object storage alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import udfs
from codeloom.functions.texts import numbered_cell, squeeze
from codeloom.sources.schemas import ASSIGNMENT, CODE

#: Accepted header names, lower-case.
ID_HEADERS, TEXT_HEADERS, CODE_HEADERS = ("number", "no", "id"), ("response", "content", "text"), ("code",)
REPEAT_STEP = 1000
RESPONSE_JSON = "id bigint, question string, content string, source string, meta map<string,string>"


def source_from_path(path: str) -> str:
    """A sample's name from a file name: its words joined by hyphens, without numbers and file type."""
    name = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1]).lower()
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    return "-".join(words) or "corpus"


def source_column(path_column: str = "_metadata.file_name"):
    base = F.lower(F.regexp_replace(F.col(path_column), r"\.[^.]*$", ""))
    words = F.filter(F.split(base, r"[^a-z0-9]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    return F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise(F.lit("corpus"))


def attach_question(responses: DataFrame, question: str) -> DataFrame:
    return responses.withColumn("question", F.lit(question))


def ordered(responses: DataFrame) -> DataFrame:
    return responses.orderBy("source", "response_id")


def read_corpus_json(spark: SparkSession, path: str, question: str | None = None, source: str | None = None) -> DataFrame:
    """Canonical corpus JSON {"responses": [...]} or a bare list of responses; one JSON document a file."""
    both = T.StructType(T.StructType.fromDDL(RESPONSE_JSON).fields + [T.StructField("responses", T.ArrayType(T.StructType.fromDDL(RESPONSE_JSON)))])
    raw = spark.read.schema(both).json(path, multiLine=True)
    wrapped = raw.where("responses is not null").select(F.explode("responses").alias("r")).select("r.*")
    rows = wrapped.unionByName(raw.where("responses is null and id is not null").drop("responses"))
    return _responses(rows.withColumnRenamed("id", "response_id"), path, question, source)


def _responses(rows: DataFrame, path: str, question: str | None, source: str | None) -> DataFrame:
    have = set(rows.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    return rows.select(
        F.col("response_id").cast("bigint").alias("response_id"),
        (F.lit(question) if question is not None else F.coalesce(col("question"), F.lit(""))).alias("question"),
        F.coalesce(col("content"), F.lit("")).alias("content"),
        (F.lit(source) if source is not None else F.coalesce(col("source"), F.lit(source_from_path(path)))).alias("source"),
        col("meta", "map<string,string>").alias("meta"),
    )


def read_csv_rows(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Raw rows of text; a byte order mark does not become part of the first name or cell."""
    df = spark.read.csv(path, header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    clean = [F.regexp_replace(F.col(f"`{c}`"), "^﻿", "").alias(c.lstrip("﻿").strip()) for c in df.columns]
    return df.select(*clean)


def require(columns: list[str], accepted: tuple[str, ...]) -> str:
    """The first column whose name is accepted."""
    by_name = {c.strip().lower(): c for c in reversed(columns)}
    for a in accepted:
        if a in by_name:
            return by_name[a]
    raise ValueError(f"none of {', '.join(accepted)} among the columns {', '.join(columns)}")


def is_numbered(cells: DataFrame, column: str = "cell") -> bool:
    """Whether all cells that are not blank are numbered, and there are some."""
    full = cells.where(F.trim(F.coalesce(column, F.lit(""))) != "")
    row = full.agg(F.count(F.lit(1)).alias("n"), F.count(numbered_cell(column)).alias("k")).first()
    return row["n"] > 0 and row["n"] == row["k"]


def assign_ids(entries: DataFrame, step: int = REPEAT_STEP) -> DataFrame:
    """(response_id, row, text) of (row, number, text): the k-th repeat of a number gets number + step * k in file order.
    Ids that then collide are an error for the caller: see collisions()."""
    again = F.row_number().over(Window.partitionBy("number").orderBy("row")) - 1
    return entries.select((F.col("number") + F.lit(step) * again).cast("bigint").alias("response_id"), "row", "text")


def collisions(ids: DataFrame) -> DataFrame:
    return ids.groupBy("response_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_numbered_csv(spark: SparkSession, path: str, question: str = "", source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Responses of a one-column CSV of cells "NN. text", and the rows whose trimmed third column says something else."""
    raw = read_csv_rows(spark, path, header=True)
    first, third = raw.columns[0], raw.columns[2] if len(raw.columns) > 2 else None
    # file order: the rank of a row in its file; one file is one reader's rows
    rows = raw.withColumn("row", F.monotonically_increasing_id()).withColumn("cell", numbered_cell(F.col(f"`{first}`"))).where("cell is not null")
    entries = rows.select("row", "cell.number", "cell.text", *([F.col(f"`{third}`").alias("trimmed")] if third else []))
    ids = assign_ids(entries)
    if collisions(ids).limit(1).count():
        raise ValueError(f"{path}: repeated numbers collide with other ids")
    fixed = udfs.repair_mojibake(spark)
    out = _responses(ids.withColumn("content", F.trim(fixed("text"))), path, question, source)
    differ = entries.where((squeeze("text") != squeeze("trimmed")) & (F.trim("trimmed") != "")).select("row", "number") if third else entries.where("false").select("row", "number")
    return out, differ


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header row, or an .xlsx workbook where openpyxl is installed."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        return read_workbook(spark, path)
    return read_csv_rows(spark, path, header=True)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a sheet under its header. Workbooks are small and read on the driver; keep them as Parquet after that."""
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl, which is not installed; export the sheet as CSV") from e
    import io

    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    book = load_workbook(io.BytesIO(bytes(data)), read_only=True, data_only=True)
    rows = [[None if c is None else str(c) for c in r] for r in (book[sheet] if sheet else book.active).iter_rows(values_only=True)]
    rows = [r for r in rows if any(c and c.strip() for c in r)]
    if not rows:
        raise ValueError(f"{path}: the sheet is empty")
    names = [(c or f"column_{k}").strip() for k, c in enumerate(rows[0])]
    return spark.createDataFrame([tuple(r) for r in rows[1:]], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_responses_table(spark: SparkSession, path: str, question: str = "", source: str | None = None) -> DataFrame:
    """Number and Response columns; a number that comes twice is an error."""
    t = read_table(spark, path)
    i, c = require(t.columns, ID_HEADERS), require(t.columns, TEXT_HEADERS)
    rows = t.select(F.expr(f"try_cast(`{i}` as bigint)").alias("response_id"), udfs.repair_mojibake(spark)(F.trim(F.col(f"`{c}`"))).alias("content")).where("response_id is not null")
    if collisions(rows).limit(1).count():
        raise ValueError(f"{path}: a number comes twice")
    return _responses(rows, path, question, source)


def read_coded_table(spark: SparkSession, path: str) -> DataFrame:
    """A hand coding: Number, Response (the segment) and Code as assignment rows."""
    t = read_table(spark, path)
    i, s, c = require(t.columns, ID_HEADERS), require(t.columns, TEXT_HEADERS), require(t.columns, CODE_HEADERS)
    return t.select(F.expr(f"try_cast(`{i}` as bigint)").alias("response_id"), F.trim(F.col(f"`{s}`")).alias("segment"), F.trim(F.col(f"`{c}`")).alias("code")).where("response_id is not null and code <> ''")


def read_tagged_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(row, tag, content); blank rows are skipped, a tag without content stays, content without a tag is an error."""
    t = read_csv_rows(spark, path, header=True)
    tag, content = require(t.columns, ("tag", "code")), require(t.columns, ("content", "segment", "text"))
    rows = t.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{tag}`"), F.lit("")).alias("tag"), F.coalesce(F.col(f"`{content}`"), F.lit("")).alias("content")).where("trim(tag) <> '' or trim(content) <> ''")
    if rows.where("trim(tag) = ''").limit(1).count():
        raise ValueError(f"{path}: a segment has no tag")
    return rows


def read_definitions_md(spark: SparkSession, path: str, heading: str = "3") -> DataFrame:
    """(name, description, count) from the section of a codebook Markdown whose title starts with `heading`: lines
    "- **family-sub** (n=4): text" and "**family**: text"."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("text").rlike(r"^##\s"), F.trim(F.regexp_replace("text", r"^##\s+", "")))
    body = lines.withColumn("section", F.last(title, ignorenulls=True).over(w)).where(F.col("section").startswith(heading))
    pattern = r"^\s*[-*]?\s*\**([A-Za-z0-9_]+(?:-[A-Za-z0-9_-]+)?)\**\s*(?:\(n\s*=\s*(\d+)\))?\s*\**\s*:\s*\**\s*(.+?)\s*$"
    hit = body.where(F.col("text").rlike(pattern))
    get = lambda k: F.regexp_extract("text", pattern, k)
    return hit.select(get(1).alias("name"), get(3).alias("description"), F.when(get(2) != "", get(2).cast("bigint")).alias("count"))


def read_codebook_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """codes and evidence of a codebook file: a bare list of codes or {"codes": [...]}."""
    shape = T.StructType(T.StructType.fromDDL(CODE).fields + [T.StructField("codes", T.ArrayType(T.StructType.fromDDL(CODE)))])
    raw = spark.read.schema(shape).json(path, multiLine=True)
    rows = raw.where("codes is not null").select(F.explode("codes").alias("c")).select("c.*").unionByName(raw.where("codes is null and name is not null").drop("codes"))
    codes = rows.select(F.col("id").alias("code_id"), "name", F.coalesce("description", F.lit("")).alias("description"), "parent_id", "created_in_snapshot")
    evidence = rows.select(F.col("id").alias("code_id"), F.explode("evidence").alias("e")).select("code_id", "e.response_id", "e.quote", F.col("e.span")[0].alias("start"), F.col("e.span")[1].alias("end"), F.coalesce("e.verified", F.lit(False)).alias("verified"), "e.score")
    return codes, evidence


def read_assignments_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSIGNMENT).json(path, multiLine=True)


def sniff(spark: SparkSession, path: str) -> str:
    """What a JSON file holds: codebook, assignments, corpus or unknown."""
    names = set(spark.read.json(path, multiLine=True).columns)
    if "codes" in names or {"name", "evidence"} <= names:
        return "codebook"
    if {"response_id", "code"} <= names:
        return "assignments"
    return "corpus" if "responses" in names or {"id", "content"} <= names else "unknown"


def load_corpus(spark: SparkSession, path: str, question: str | None = None, source: str | None = None) -> DataFrame:
    """A corpus by file type: JSON, numbered or headed CSV, workbook, Parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "json":
        return read_corpus_json(spark, path, question, source)
    if kind == "csv":
        raw = read_csv_rows(spark, path, header=True)
        if is_numbered(raw.select(F.col(f"`{raw.columns[0]}`").alias("cell"))):
            return read_numbered_csv(spark, path, question or "", source)[0]
        return read_responses_table(spark, path, question or "", source)
    if kind in ("xlsx", "xlsm"):
        return read_responses_table(spark, path, question or "", source)
    return _responses(spark.read.parquet(path), path, question, source)


def load_corpus_with_report(spark: SparkSession, path: str, question: str | None = None, source: str | None = None) -> tuple[DataFrame, dict]:
    rows = load_corpus(spark, path, question, source)
    n = rows.agg(F.count(F.lit(1)).alias("responses"), F.countDistinct("source", "response_id").alias("distinct_ids"), F.sum((F.trim("content") == "").cast("long")).alias("empty"), F.sum((F.col("response_id") >= REPEAT_STEP).cast("long")).alias("renumbered")).first()
    return rows, n.asDict()
