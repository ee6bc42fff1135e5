"""Bounded samples of labelled rows: the only data that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable=None) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of about per_class rows of either class 0 and 1, chosen by a hash of the id, and the classes' true
    sizes. Ids labelled twice count once, by their larger label; null ids and labels are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(f"{label} sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, F.lit(per_class / max(1, sizes.get(1, 0)))).otherwise(F.lit(per_class / max(1, sizes.get(0, 0))))
    # about 2 * per_class ids, whatever the number of labels: that bounds what is broadcast, and no text is shuffled
    return docs.select("doc_id", "text").join(F.broadcast(known.where(part < share)), "doc_id").select("text", "label"), sizes
