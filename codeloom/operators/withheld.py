"""A guard against reproducing withheld texts: any shared run of characters counts.

Runs meet by a 64-bit hash. The withheld side is a query set: its distinct hashes are dealt into blocks of at most BLOCK, each
block is broadcast, and every text is read once a block, whole. Nothing of the texts is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import kernels
from codeloom.runtime import ship

SHINGLE = 20
#: Hashes (8 bytes each) that are broadcast at a time.
BLOCK = 2_000_000


def _plain(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def first_hits(texts: DataFrame, withheld: DataFrame, key: str, n: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(key, at): offset in the squeezed lower-case text of the first run of n characters that a withheld text has too, one row
    a key however often it comes. Shorter texts count whole."""
    spark = texts.sparkSession
    ship(spark)

    def hashes(batches):
        for b in batches:
            found = [kernels.gram_hashes(_plain(t), n) for t in b["text"]]
            yield pd.DataFrame({"h": np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)).view(np.int64)})

    known = withheld.select("text").mapInPandas(hashes, "h bigint").distinct()
    parts = max(1, -(-known.count() // block))
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for part in range(parts):
        own = known if parts == 1 else known.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in own.toLocalIterator()], dtype=np.int64)))

        def run(batches, shared=shared):
            for b in batches:
                rows = []
                for k, t in zip(b["__key"].tolist(), b["text"]):
                    h = kernels.gram_hashes(_plain(t), n).view(np.int64)
                    spot = np.searchsorted(shared.value, h)
                    hit = np.flatnonzero(shared.value[np.minimum(spot, len(shared.value) - 1)] == h) if len(shared.value) else ()
                    if len(hit):
                        rows.append((k, int(hit[0])))
                yield pd.DataFrame(rows, columns=[key, "at"])

        found = texts.select(F.col(key).alias("__key"), "text").mapInPandas(run, f"{key} {kind}, at int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy(key).agg(F.min("at").alias("at"))
