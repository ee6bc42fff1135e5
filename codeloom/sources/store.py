"""The store: Parquet tables with content-derived keys.

Rows are only ever appended. A row whose key is there already is left out by an anti-join, so a step that is run again after
a lost executor or a restart writes nothing twice; a snapshot whose id exists must be the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.sources.schemas import TABLES


class Conflict(ValueError):
    """A key that exists with other content."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[name][0])

    def read(self, name: str) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> int:
        """Append the rows whose key is new; returns how many."""
        key = TABLES[name][1]
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(name)])
        new = shaped.dropDuplicates(key).join(self.read(name).select(*key), key, "left_anti").select(*shaped.columns)
        new = new.checkpoint() if self.spark.sparkContext.getCheckpointDir() else new.persist()
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.path(name))
        return n

    def write_snapshot(self, snapshot_id: str, codebook_json: str, **columns) -> bool:
        """Whether the snapshot is new; the same id with another text is an error."""
        there = self.read("snapshots").where(F.col("snapshot_id") == snapshot_id).select("codebook_json").first()
        if there is not None:
            if there["codebook_json"] != codebook_json:
                raise Conflict(f"snapshot {snapshot_id} exists with other content")
            return False
        row = {"snapshot_id": snapshot_id, "codebook_json": codebook_json} | columns
        self.append("snapshots", self.spark.createDataFrame([row], T.StructType([f for f in self.schema("snapshots") if f.name in row])))
        return True

    def emit(self, run_id: str, events: list[tuple]) -> None:
        """Append audit events (event, scope, subject, snapshot_id, payload) of one run, numbered on from its last."""
        last = self.read("audit").where(F.col("run_id") == run_id).agg(F.max("event_id")).first()[0] or 0
        rows = [(run_id, last + k, "", *e) for k, e in enumerate(events, 1)]
        self.append("audit", self.spark.createDataFrame(rows, self.schema("audit")))

    def latest(self, name: str, order: str) -> DataFrame:
        """The last row of each key by a column."""
        w = Window.partitionBy(*TABLES[name][1]).orderBy(F.desc(order))
        return self.read(name).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")

    def coded_responses(self, run_id: str) -> DataFrame:
        return self.read("assignments").where(F.col("run_id") == run_id).select("response_id").distinct()

    def findings_summary(self, run_id: str) -> DataFrame:
        return self.read("findings").where(F.col("run_id") == run_id).groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"))
