"""Readings of an audit log (run_id, event_id, event, subject, payload JSON).

Attribution to the next or the last marker is a window over the event order of one run; a run is written by one process, and
runs are what windows are partitioned by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("run_id").orderBy("event_id")


def field(name: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{name}").cast(kind)


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def batch_of_response(events: DataFrame) -> DataFrame:
    """(run_id, response_id, batch): each prepared response belongs to the next evaluated boundary; those after the last one
    make a batch of their own."""
    marked = events.where("event in ('response_prepared', 'checkpoint_evaluated')").withColumn("batch", F.when(F.col("event") == "checkpoint_evaluated", field("batch", "long")))
    ahead = F.first("batch", ignorenulls=True).over(_order().rowsBetween(0, Window.unboundedFollowing))
    last = F.max("batch").over(Window.partitionBy("run_id"))
    x = marked.withColumn("next", F.coalesce(ahead, last + 1, F.lit(1)))
    return x.where("event = 'response_prepared'").groupBy("run_id", F.col("subject").cast("long").alias("response_id")).agg(F.max_by("next", "event_id").alias("batch"))


def judge_calls(events: DataFrame) -> DataFrame:
    """(run_id, response_id, n): judge calls attributed to the last response prepared before them."""
    own = F.when(F.col("event") == "response_prepared", F.col("subject").cast("long"))
    x = events.where("event in ('response_prepared', 'judge_consulted')").withColumn("at", F.last(own, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("event = 'judge_consulted' and at is not null").groupBy("run_id", F.col("at").alias("response_id")).agg(F.count(F.lit(1)).alias("n"))


def last_per_subject(events: DataFrame, event: str, name: str, kind: str = "long") -> DataFrame:
    """(run_id, subject, value): a payload field of the last such event of each subject."""
    return events.where(F.col("event") == event).groupBy("run_id", "subject").agg(F.max_by(field(name, kind), "event_id").alias("value"))


def created_and_merged(events: DataFrame) -> DataFrame:
    """(run_id, response_id, event, codes) in event order; the codes of one response are a bounded list."""
    x = events.where("event in ('code_created', 'code_merged')").withColumn("response_id", field("response_id", "long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "subject"))), lambda v: v["subject"])
    return x.groupBy("run_id", "response_id", "event").agg(F.array_join(listed, "|").alias("codes"))


def brackets(events: DataFrame, opening: str, closing: str) -> DataFrame:
    """Events with the number of the bracket they stand in (0 before the first), counted by opening markers, and whether it is
    still open."""
    opened = F.sum((F.col("event") == opening).cast("long")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    closed = F.sum((F.col("event") == closing).cast("long")).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("bracket", opened).withColumn("open", opened > F.coalesce(closed, F.lit(0)))


def paired(events: DataFrame, started: str, decided: str) -> DataFrame:
    """Decided events with the payload of the last started one before."""
    prior = F.last(F.when(F.col("event") == started, F.col("payload")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("started_payload", prior).where(F.col("event") == decided)


def since_marker(events: DataFrame, counted: str, marker: str) -> DataFrame:
    """(run_id, n): events counted since the last marker, all of them without one."""
    last = events.where(F.col("event") == marker).groupBy("run_id").agg(F.max("event_id").alias("at"))
    x = events.where(F.col("event") == counted).join(last, "run_id", "left")
    return x.groupBy("run_id").agg(F.sum((F.col("at").isNull() | (F.col("event_id") > F.col("at"))).cast("long")).alias("n"))


def renamed_ids(events: DataFrame) -> DataFrame:
    """(run_id, old_id, new_id) of applied operations, from a map in the payload."""
    m = F.from_json(F.get_json_object("payload", "$.renamed"), "map<string,string>")
    return events.where("event = 'operation_applied'").select("run_id", F.explode(m).alias("old_id", "new_id"))


def call_totals(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per task; calls: (task, input_tokens, output_tokens, input_rate, output_rate)."""
    cost = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6
    return calls.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost_usd"))
