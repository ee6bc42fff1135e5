"""Shared helpers: table access, lineage cuts in the shared folder, Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import ship

#: Rows of text that one Arrow batch carries at most; long texts make a batch end earlier.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Python workers hold one batch of whole texts at a time, so its size is what bounds their memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="codeloom-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Bytes of input behind one written file: far fewer files than tasks of small splits would leave.
FILE_BYTES = 64 << 20


def compact(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in as many partitions as its source's files fill FILE_BYTES, in whole waves of the cluster's cores; a merge of
    neighbouring partitions without a shuffle."""
    spark = df.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # an unknown size is huge, and merging into more partitions than there are changes nothing
    return df.coalesce(min(1_000_000, cores * max(1, -(-size // (FILE_BYTES * cores)))))


def cut(df: DataFrame, label: str, source: DataFrame | None = None, held: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, and what is
    computed once stays readable when executors are lost. With a source, its size decides the number of files; `held` is
    given the table's path, for `discard`."""
    path = f"{shared_dir(df.sparkSession)}/codeloom-{label}-{uuid.uuid4().hex}"
    if held is not None:
        held.append(path)
    (df if source is None else compact(df, source)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Delete tables of `cut` once what was made of them is written itself."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while held:
        path = jvm.org.apache.hadoop.fs.Path(held.pop())
        path.getFileSystem(conf).delete(path, True)


def arrow_rows(df: DataFrame, columns: list[str], schema: str, each: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """mapInArrow over the named columns; `each` gets a batch and returns one dict of column lists or arrays."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = each(b)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    bound_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def text_udf(spark: SparkSession, returns: str, each: Callable) -> Callable:
    """A scalar Arrow function over columns: `each` gets one Python value of every column and returns one."""
    import pandas as pd

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([each(*row) for row in zip(*columns)], dtype=object)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    bound_batches(spark)
    return F.pandas_udf(run, returns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until df has no column of that name (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n.lower())
    return out


def named(names: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def with_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds what tells rows apart whatever the ids hold, under names that docs does not have: the id (nulls as one value) and
    the text's hash."""
    kid, kth = fresh(docs, "kid", "kth")
    return docs.withColumn(kid, F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(kth, F.xxhash64("text")), [kid, kth]
