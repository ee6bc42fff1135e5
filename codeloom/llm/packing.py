"""Packing into fixed windows by best-fit decreasing.

A document's ids, with the end id after them, are first cut into full windows; what is left is shorter than a window.
Best-fit decreasing then takes the pieces by falling length and puts each into the tightest open window, which a segment
tree indexed by remaining capacity finds. A piece's place depends on its length only, so the plan is made from the number
of pieces of each length (at most `window` numbers, whatever the corpus), for runs of equal pieces at once. Each piece
then finds its place by its rank among the pieces of its length, which partial counts over hashed buckets give without a
global sort and without gathering a length in one task.

Defined cases: null and empty texts are the end id alone; texts of any length are cut, never dropped; equal rows are
packed each on its own (ties fall by document id, start and checksum); an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, cut

WINDOW = 1024
END_ID = 0
#: Pieces that a rank bucket holds on average.
BUCKET_ROWS = 200_000
#: Longest run without white space that the fast encoder gets; it is quadratic in the run.
LONG_RUN = 4000


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf counts the open windows with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that has an open window."""
        k = self.leaves + need
        if self.count[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def plan(lengths: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for {length: number of pieces}, as runs (length, rank from, rank before, sequence, pieces a
    window, offset): the piece of rank r goes to sequence + (r - from) // pieces, at offset + (r - from) % pieces * length."""
    tree, open_at, steps, fresh = CapacityTree(window), {}, [], 0

    def give(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_at.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                first, n = fresh, -(-left // each)
                fresh += n
            else:
                each = room // length
                first, n = open_at[room].pop()
                tree.add(room, -n)
            full = min(n, left // each)
            take, rest = full * each, 0
            if full < n and take < left:
                rest = left - take
                take = left
            steps.append((length, rank, rank + take, first, each, window - room))
            give(room - each * length, first, full)
            if rest:
                give(room - rest * length, first + full, 1)
            give(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + take, left - take
    return steps


def encoder(tokenizer: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizers file named. Where the file's merges are those of the plain byte-level scheme, a
    table-driven encoder built from that same file gives the same ids several times as fast; texts that hold a special
    token's string or very long runs without white space go through the tokenizer itself."""
    import json
    import re

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    slow = lambda text: np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("dropout") or spec.get("normalizer"):
        return slow
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    # fixed pattern of the byte-level scheme
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join([*map(re.escape, special), rf"\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}"]))
    return lambda text: slow(text) if odd.search(text) else np.asarray(fast.encode_ordinary(text), dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the full windows and the rest of each document."""
    made = {}

    def each(batch) -> dict:
        if "encode" not in made:
            made["encode"] = encoder(tokenizer)
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(made["encode"](t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                out["doc_id"].append(doc)
                out["start"].append(start)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                out["doc_tokens"].append(len(ids))
        return out

    return arrow_rows(docs, ["doc_id", text], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", each)


def place(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces by best-fit decreasing."""
    spark = parts.sparkSession
    buckets = max(1, parts.count() // BUCKET_ROWS)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # at most `window` rows come to the driver, and the plan's size depends on `window` alone
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(lengths, window)
    runs = spark.createDataFrame(steps or [(0, 0, 0, 0, 1, 0)], "length long, rank_from long, rank_before long, first long, each long, base long")
    ranked = (
        keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
        .join(counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before")), ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    step = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_before")))
        .select("doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + step % F.col("each") * ranked["length"]).cast("long").alias("offset"))
    )


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return place(cut(pieces(docs, tokenizer, window), "pieces", docs), window)
