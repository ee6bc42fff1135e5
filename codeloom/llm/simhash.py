"""SimHash near-duplicates by a binary trie self-join.

A fingerprint's bit is 1 if it is set in over half the hashes of the text's word shingles. The distinct fingerprints are
the leaves of a binary trie. Two nodes are traversed together; each level adds a differing bit where their branches
differ, and a pair whose bits exceed the budget is pruned with all below it. To spread the trie over tasks, the bits are
rotated so that each of budget + 1 disjoint blocks comes first once: two fingerprints within the budget agree in one block
at least, so every link lies below one common node at the depth of a block. Such a subtrie with more than SUBTRIE leaves is
dealt out as pairs of parts, so no task gets an unbounded group. Each task returns a spanning forest of its links, not all
pairs; components are then found over representatives and joined to the rows.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle has are
one shingle; equal rows share a fingerprint and a component; documents without links are their own component; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, compact, cut, named, with_key
from codeloom.llm.components import components
from codeloom.operators.joins import hot_join

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
BITS = 64
#: Leaves that a part of a subtrie has at most, and pairs of nodes that are held at a time.
SUBTRIE = 20_000
FRONTIER = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle in order, big-endian; fewer words are one shingle, none are no shingle. bytes.split() splits at
    exactly 0x20 and 0x09-0x0D."""
    from xxhash import xxh64_digest

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=">u8")
    line, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends[:-1]]
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    return np.frombuffer(b"".join([xxh64_digest(line[a : b - 1], SEED) for a, b in zip(starts, last)]), dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the big-endian hashes have set."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def each(batch) -> dict:
        fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "fp": fps}

    return arrow_rows(docs, ["doc_id", "text"], "doc_id long, fp long", each)


def trie_links(leaves: np.ndarray, roots: list[tuple[int, int, int, int]], depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked leaves. leaves: sorted uint64 within each range; roots: node pairs (lo, hi, lo, hi) as ranges of
    leaves that share their first `depth` bits; equal ranges are a node with itself."""
    found_a, found_b = [], []
    todo = [(depth, np.asarray(roots, dtype=np.int64).reshape(-1, 4), np.zeros(len(roots), dtype=np.int8))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        d, pairs, errors = todo.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            todo += [(d, pairs[:half], errors[:half]), (d, pairs[half:], errors[half:])]
            continue
        alo, ahi, blo, bhi = pairs.T
        self_pair = alo == blo
        leaf = ((ahi - alo == 1) & (bhi - blo == 1)) | (d == BITS)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            a, b = a[~self_pair[leaf]], b[~self_pair[leaf]]
            near = np.bitwise_count(leaves[a] ^ leaves[b]) <= budget
            found_a.append(a[near])
            found_b.append(b[near])
            pairs, errors = pairs[~leaf], errors[~leaf]
            alo, ahi, blo, bhi = pairs.T
            self_pair = alo == blo
        if not len(pairs):
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((leaves >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)))
        at = ones[d]
        amid, bmid = ahi - (at[ahi] - at[alo]), bhi - (at[bhi] - at[blo])
        same = [(alo, amid, blo, bmid), (amid, ahi, bmid, bhi)]
        cross = [(alo, amid, bmid, bhi, np.ones(len(pairs), dtype=bool)), (amid, ahi, blo, bmid, ~self_pair)]
        next_pairs, next_errors = [], []
        for x in same:
            keep = (x[0] < x[1]) & (x[2] < x[3]) & ~((x[0] == x[2]) & (x[1] - x[0] == 1) & (x[3] - x[2] == 1))
            next_pairs.append(np.stack(x, axis=1)[keep])
            next_errors.append(errors[keep])
        for *x, allowed in cross:
            keep = (x[0] < x[1]) & (x[2] < x[3]) & allowed & (errors < budget)
            next_pairs.append(np.stack(x, axis=1)[keep])
            next_errors.append(errors[keep] + 1)
        pairs = np.concatenate(next_pairs)
        if len(pairs):
            todo.append((d + 1, pairs, np.concatenate(next_errors)))
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each node's component, by pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    x = x.astype(np.uint64)
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def links(fps: DataFrame, budget: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, signed) that connect exactly what links of at most `budget`
    differing bits connect."""
    blocks = budget + 1
    width = BITS // blocks
    block = lambda k: F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.expr(f"(fp << {k * width}) | shiftrightunsigned(fp, {(BITS - k * width) % BITS})") if k else F.col("fp"), BITS - width).alias("node"))
    under = fps.select("fp", F.explode(F.array(*[block(k) for k in range(blocks)])).alias("x")).select("fp", "x.block", "x.node")
    sizes = under.groupBy("block", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / subtrie).cast("int")
    dealt = (
        under.join(sizes, ["block", "node"])
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("fp", "block", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def run(batches):
        """Batches come sorted by group; a group cut by the end of a batch waits for its rest."""
        import pandas as pd

        def solve(p: pd.DataFrame) -> pd.DataFrame:
            p = p.reset_index(drop=True)
            turned = np.empty(len(p), dtype=np.uint64)
            raw = p["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            blk = p["block"].to_numpy()
            for k in range(blocks):
                m = blk == k
                turned[m] = _rotate(raw[m], k * width)
            group = p.groupby(["block", "node", "i", "j"], sort=False).ngroup().to_numpy()
            own = p["own"].to_numpy()
            order = np.lexsort((turned, own, group))
            turned, group, own = turned[order], group[order], own[order]
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (own[1:] != own[:-1])])
            ends = np.r_[cuts[1:], len(group)]
            i, j = p["i"].to_numpy()[order][cuts], p["j"].to_numpy()[order][cuts]
            roots = [(a, b, a, b) for a, b, x, y in zip(cuts, ends, i, j) if x == y]
            g = group[cuts]
            roots += [(cuts[k], ends[k], cuts[k + 1], ends[k + 1]) for k in range(len(cuts) - 1) if g[k] == g[k + 1]]
            a, b = trie_links(turned, roots, width, budget) if roots else (np.zeros(0, int), np.zeros(0, int))
            label = forest(len(turned), a, b)
            signed = raw[order].view(np.int64)
            linked = np.flatnonzero(label != np.arange(len(turned)))
            return pd.DataFrame({"a": signed[linked], "b": signed[label[linked]]})

        held: list[pd.DataFrame] = []
        rows, key = 0, ["block", "node", "i", "j"]
        for b in batches:
            if not len(b):
                continue
            p = pd.concat([*held, b]) if held else b
            last = (p[key] != p[key].iloc[-1]).any(axis=1).to_numpy()
            done = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if done >= 100_000 or (done and rows > 400_000):
                yield solve(p.iloc[:done])
                held, rows = [p.iloc[done:]], len(p) - done
            else:
                held, rows = [p], len(p)
        if held:
            yield solve(pd.concat(held))

    spread = dealt.repartition("block", "node", "i", "j").sortWithinPartitions("block", "node", "i", "j")
    return spread.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every row."""
    own = cut(fingerprints(docs, words), "fingerprints", docs)
    of = _least(own, "doc_id", budget, subtrie).withColumnRenamed("least", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return hot_join(own, of, ["fp"], "copies", own.count()).select("doc_id", hexed.alias("fingerprint"), "component_id")


def _least(own: DataFrame, key, budget: int, subtrie: int) -> DataFrame:
    """(fp, copies, least): for every distinct fingerprint, its rows and the least key of all rows in its component."""
    classes = cut(own.groupBy("fp").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("copies")), "classes")
    found = components(links(classes.select("fp"), budget, subtrie))
    labelled = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "copies", "key", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("times"))
    return cut(hot_join(labelled, least, ["label"], "times", classes.count()).select("fp", "copies", "least"), "least")


def representatives(docs: DataFrame, words: int = 3, budget: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """One row, with all its columns, of each component: that with the least id (null ids first), then the least text hash."""
    keyed, key = with_key(docs)

    def each(batch) -> dict:
        fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
        return {"kid": batch.column(0), "kth": batch.column(1), "fp": fps}

    own = cut(arrow_rows(keyed, [*key, "text"], "kid long, kth long, fp long", each), "fingerprints", docs)
    chosen = _least(own, F.struct(F.col("kid").alias(key[0]), F.col("kth").alias(key[1])), budget, subtrie).select("least.*").distinct()
    return compact(keyed.join(chosen, key, "left_semi").dropDuplicates(key).select(*named(docs.columns)), docs)
