"""Timelines and trails out of audit logs (run_id, event_id, event, subject, payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import eventlog


def batch_summary(events: DataFrame) -> DataFrame:
    """(run_id, batch, n_responses, n_new_codes, n_judge_calls)."""
    of = eventlog.batch_of_response(events)
    created = events.where("event = 'code_created'").select("run_id", eventlog.field("response_id", "long").alias("response_id"), F.col("subject").alias("code"))
    new = created.join(of, ["run_id", "response_id"]).groupBy("run_id", "batch").agg(F.countDistinct("code").alias("n_new_codes"))
    judged = eventlog.judge_calls(events).join(of, ["run_id", "response_id"]).groupBy("run_id", "batch").agg(F.sum("n").alias("n_judge_calls"))
    size = of.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("n_responses"))
    return size.join(new, ["run_id", "batch"], "left").join(judged, ["run_id", "batch"], "left").na.fill(0, ["n_new_codes", "n_judge_calls"])


def biographies(events: DataFrame) -> DataFrame:
    """(run_id, code, born_event, born_response, n_merged, last_merge, fate, successor): a code's birth, what was merged into it
    and how it ended, from events in order. Renames and merges of a script are read from operation_applied payloads
    {"renamed": {old: new}}."""
    made = events.where("event = 'code_created'").groupBy("run_id", F.col("subject").alias("code")).agg(F.min("event_id").alias("born_event"), F.min_by(eventlog.field("response_id", "long"), "event_id").alias("born_response"))
    merged = events.where("event = 'code_merged'").groupBy("run_id", F.col("subject").alias("code")).agg(F.count(F.lit(1)).alias("n_merged"), F.max("event_id").alias("last_merge"))
    gone = eventlog.renamed_ids(events).select("run_id", F.col("old_id").alias("code"), F.col("new_id").alias("successor")).dropDuplicates(["run_id", "code"])
    x = made.join(merged, ["run_id", "code"], "left").na.fill(0, ["n_merged"]).join(gone, ["run_id", "code"], "left")
    return x.withColumn("fate", F.when(F.col("successor").isNotNull(), "renamed").otherwise("alive"))


def checkpoints(events: DataFrame) -> DataFrame:
    """(run_id, decided_event, started_payload, payload): decided checkpoints with what the last start before them said."""
    x = eventlog.paired(events, "checkpoint_started", "checkpoint_decided")
    return x.select("run_id", F.col("event_id").alias("decided_event"), "started_payload", "payload")


def lineage(before: DataFrame, renamed: DataFrame) -> DataFrame:
    """(old_name, new_id) for every code of a base codebook (code_id, name) that operations renamed (old_id, new_id)."""
    return before.join(renamed, before["code_id"] == renamed["old_id"]).select(F.col("name").alias("old_name"), "new_id")


def first_appearance(occ: DataFrame, place_of: DataFrame) -> DataFrame:
    """(code, place, response_id) of the first response, in coding order, that carries each code."""
    w = Window.partitionBy("code").orderBy("place")
    return occ.join(place_of, "response_id").withColumn("k", F.row_number().over(w)).where("k = 1").select("code", "place", "response_id")
