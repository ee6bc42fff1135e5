"""Near copies: SimHash links of the trie self-join and, beyond their reach, min-hash candidates; exact shingle similarity decides.

A text's shingles are the set of its runs of `words` words, as 64-bit hashes. Texts with equal sets are one class. Candidates come
from two sides. First, the binary trie self-join of simhash.py over the classes' fingerprints, with BUDGET differing bits. At a
similarity of 0.8, however, two fingerprints differ in about ten of 64 bits, a budget under which a trie prunes almost nothing, so
the method alone cannot find those pairs (README: the share it finds). So each class also has BANDS fingerprints, each of ROWS
min-hashes: two classes of similarity s (shared shingles by all shingles of both) have one of them at least in common with
probability 1 - (1 - s^ROWS)^BANDS, which is 0.9997 at 0.8.

Classes with a common fingerprint are a bucket. First all of a bucket are compared with its least class. Where a bucket's classes
are then in several components, they are put in an order by chance and each is compared with the next REACH, a number of pairs in
proportion to the classes, which connects most of a group that has no centre. Whoever is still apart
from most of its bucket is then joined, by prefix, with all classes of such buckets: shingles are ordered from the rarest on, and two
sets of similarity s have one of the first (1 - s) of each in common, at places that leave enough of both behind them. This is
exact, so every pair of a bucket is compared, connected by others or known to be apart, and pairs that differ in their rare
shingles are never made. Work still grows with the square of the classes that stay apart though they have a frequent shingle in their
prefixes. Links are decided by the sets alone; components are found over classes.

Defined cases: upper and lower case of ASCII are equal; null and empty texts are one class; fewer words than a shingle has are
one shingle; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import simhash
from codeloom.llm.common import arrow_rows, compact, cut, named, with_key
from codeloom.llm.components import components
from codeloom.llm.simhash import SEED
from codeloom.operators.joins import hot_join

WORDS, SIMILARITY = 5, 0.8
#: Bits in which linked fingerprints of the trie differ at most.
BUDGET = 3
BANDS, ROWS = 20, 5
#: By how much the share of equal min-hashes may fall short of the similarity.
MARGIN = 0.2
#: How many of the next classes of its bucket a class is compared with, and classes that are put in order together.
REACH, PART = 2, 1000
#: Ratio of the sizes of sets in neighbouring bins.
BIN = 1.05
#: Shingles whose min-hashes are taken at a time.
CHUNK = 2048
_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; a text without words has the empty run."""
    return distinct(simhash.shingle_hashes(text, words))


def distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.astype(np.uint64)) if len(hashes) else np.zeros(1, dtype=np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (np.multiply.outer(_FACTORS, hashes[k : k + CHUNK]) + _SHIFTS[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The fingerprints of a text's min-hashes, told apart by their band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _sketches(keyed: DataFrame, key: list[str], words: int) -> DataFrame:
    """(kid, kth, cls, fp, bands, low) of every row; low: 16 bits of each min-hash."""

    def each(batch) -> dict:
        from xxhash import xxh64_intdigest

        raw = [simhash.shingle_hashes(t.as_py(), words) for t in batch.column(2)]
        sets = [distinct(h) for h in raw]
        signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        cls, fp = signed([xxh64_intdigest(s.tobytes(), SEED) for s in sets]), signed([simhash.majority(h) for h in raw])
        least = [min_hashes(s) for s in sets]
        return {"kid": batch.column(0), "kth": batch.column(1), "cls": cls, "fp": fp, "bands": [bands(x) for x in least], "low": [x.astype(np.uint16).tobytes() for x in least]}

    return arrow_rows(keyed, [*key, "text"], "kid long, kth long, cls long, fp long, bands array<long>, low binary", each)


def _trie_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that connect what the trie self-join of their fingerprints connects."""
    of = cut(classes.groupBy("fp").agg(F.min("cls").alias("first")), "leaves")
    same = classes.join(of, "fp").where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    near = simhash.links(of.select("fp"), BUDGET)
    x, y = (of.select(F.col("fp").alias(n), F.col("first").alias(f"{n}_first")) for n in ("a", "b"))
    return same.union(near.join(x, "a").join(y, "b").select("a_first", "b_first"))


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose min-hashes agree often enough: a pair of `similarity` agrees in that share of them, give or take
    0.04 at 0.8, and one that agrees MARGIN less often (five times that) is not looked at in full."""
    x, y = (classes.select(F.col("cls").alias(n), F.col("low").alias(f"{n}_low")) for n in ("a", "b"))

    def each(batch) -> dict:
        get = lambda v: np.frombuffer(v.as_py(), dtype=np.uint16)
        near = np.array([np.count_nonzero(get(p) == get(q)) >= (similarity - MARGIN) * BANDS * ROWS for p, q in zip(batch.column(2), batch.column(3))], dtype=bool)
        return {"a": batch.column(0).to_numpy()[near], "b": batch.column(1).to_numpy()[near]}

    return cut(arrow_rows(pairs.join(x, "a").join(y, "b"), ["a", "b", "a_low", "b_low"], "a long, b long", each), "possible")


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    pairs = _possible(pairs, classes, similarity)
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    texts = keyed.join(need.join(classes, "cls").select("cls", "key.*"), ["kid", "kth"])

    def sets(batch) -> dict:
        return {"cls": batch.column(0), "own": [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]}

    of = cut(arrow_rows(texts.dropDuplicates(["cls"]), ["cls", "text"], "cls long, own binary", sets), "sets", keyed)
    both = pairs.join(of.select(F.col("cls").alias("a"), F.col("own").alias("x")), "a").join(of.select(F.col("cls").alias("b"), F.col("own").alias("y")), "b")

    def each(batch) -> dict:
        get = lambda v: np.frombuffer(v.as_py(), dtype=np.uint64)
        near = np.array([similar(get(x), get(y), similarity) for x, y in zip(batch.column(2), batch.column(3))], dtype=bool)
        return {"a": batch.column(0).to_numpy()[near], "b": batch.column(1).to_numpy()[near]}

    return cut(arrow_rows(both, ["a", "b", "x", "y"], "a long, b long", each), "links")


def _prefix_pairs(open_: DataFrame, classes: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes with other labels, one of them apart, among which are all pairs of at least `similarity`. open_:
    (cls, label, apart)."""
    texts = keyed.join(open_.join(classes.select("cls", "key.*"), "cls"), ["kid", "kth"]).dropDuplicates(["cls"])

    def each(batch) -> dict:
        own = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(3)]
        return {"cls": batch.column(0), "label": batch.column(1), "apart": batch.column(2), "n": [len(x) for x in own], "own": own}

    sets = arrow_rows(texts, ["cls", "label", "apart", "text"], "cls long, label long, apart boolean, n long, own array<long>", each)
    held = cut(sets.select("cls", "label", "apart", "n", F.explode("own").alias("token")), "shingles", keyed)
    common = held.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = hot_join(held, common.withColumn("rank", F.col("k")), ["token"], "k", held.count())
    # shingles of one class alone come first in the order and join nothing
    of = Window.partitionBy("cls")
    place = F.row_number().over(of.orderBy("rank", "token")) + F.col("n") - F.count(F.lit(1)).over(of)
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    prefix = cut(shared.select("cls", "label", "apart", "n", "token", place.alias("place")).where(F.col("place") <= first), "prefix")
    x, y = (prefix.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("cls", "label", "apart", "n", "place")]) for side in ("x", "y"))
    # how many shingles a partner may have at most, by what x has left; sizes are dealt into bins, which the join takes as a key
    widest = (1 + similarity) / similarity * (F.col("x_n") - F.col("x_place") + 1) - F.col("x_n") + 1e-6
    size_bin = lambda n: F.floor(F.log(n) / float(np.log(BIN))).cast("int")
    smallest = F.greatest(F.lit(1.0), similarity * F.col("x_n") - 1e-6)
    x = x.where("x_apart").where(widest >= smallest).withColumn("bin", F.explode(F.sequence(size_bin(smallest), size_bin(widest))))
    y = y.withColumn("bin", size_bin(F.col("y_n").cast("double")))
    rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) + 1
    fits = (rest >= similarity / (1 + similarity) * (F.col("x_n") + F.col("y_n")) - 1e-6) & (F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n") - 1e-6)
    # of two that are apart, the larger one looks for the smaller
    once = ~F.col("y_apart") | (F.struct("x_n", "x_cls") > F.struct("y_n", "y_cls"))
    met = x.join(y, ["token", "bin"]).where(F.col("x_label") != F.col("y_label")).where(fits & once)
    return met.select(F.greatest("x_cls", "y_cls").alias("a"), F.least("x_cls", "y_cls").alias("b")).distinct()


def _undecided(held: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(bucket, cls, centre, n, label, most) of the buckets whose classes are in several components; most: the label that most have.
    None if there is no such bucket. labels: (node, component)."""
    label = F.coalesce("component", "cls").alias("label")
    found = cut(held.where("n > 2").join(labels, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "centre", "n", label), "found")
    sizes = found.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("times"))
    of = cut(most.where("labels > 1").select("bucket", F.col("most.label").alias("most"), "times"), "several")
    rows, heaviest = of.agg(F.sum("times"), F.max("times")).first()
    return cut(hot_join(found, of, ["bucket"], "times", rows, heaviest=heaviest), "undecided") if rows else None


def _open(undecided: DataFrame) -> DataFrame:
    """(cls, label, apart) of their classes, but for those that all of a bucket have been compared with."""
    return cut(undecided.where("cls <> centre").groupBy("cls", "label").agg(F.max(F.col("label") != F.col("most")).alias("apart")), "open")


def _chained(undecided: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with other labels that are at most REACH places apart in their bucket's order. Each bucket has an
    order of its own, by hash, and a large one is dealt into parts."""
    chance = F.xxhash64("cls", "bucket")
    of = Window.partitionBy("bucket", F.pmod(chance, F.ceil(F.col("n") / PART))).orderBy(F.xxhash64("bucket", "cls"))
    near = [F.lead(F.struct("cls", "label"), k).over(of) for k in range(1, REACH + 1)]
    met = undecided.select("cls", "label", F.array(*near).alias("next")).select("cls", "label", F.explode("next").alias("other")).where("label <> other.label")
    return met.select(F.greatest("cls", "other.cls").alias("a"), F.least("cls", "other.cls").alias("b")).distinct()


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) once edges (a, b) are added to what labels connects."""
    return components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges))


def labels(classes: DataFrame, keyed: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the classes (cls, key, fp, bands, low) that similar pairs among the candidates connect with others. keyed:
    (kid, kth, text) of every row."""
    under = classes.select("cls", F.explode("bands").alias("bucket"))
    size = cut(under.groupBy("bucket").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    rows, heaviest = size.agg(F.sum("n"), F.max("n")).first()
    held = cut(hot_join(under, size.withColumn("times", F.col("n")), ["bucket"], "times", rows or 0, heaviest=heaviest or 0), "buckets")
    starred = held.where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b"))
    pairs = cut(starred.union(_trie_pairs(classes)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    found = components(_verified(pairs, classes, keyed, words, similarity))

    undecided = _undecided(held, found)
    if undecided is None or not _open(undecided).where("apart").limit(1).count():
        return found
    chained = cut(_chained(undecided).join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = _joined(found, _verified(chained, classes, keyed, words, similarity))
    undecided = _undecided(undecided.drop("label", "most"), found)
    open_ = None if undecided is None else _open(undecided)
    if open_ is None or not open_.where("apart").limit(1).count():
        return found
    more = cut(_prefix_pairs(open_, classes, keyed, words, similarity).join(pairs.union(chained), ["a", "b"], "left_anti"), "pairs")
    return _joined(found, _verified(more, classes, keyed, words, similarity))


def representatives(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row, with all its columns, of each component: that with the least id (null ids first), then the least text hash."""
    keyed, key = with_key(docs)
    rows = keyed.select(F.col(key[0]).alias("kid"), F.col(key[1]).alias("kth"), "text")
    own = cut(_sketches(keyed, key, words), "sketches", docs)
    classes = cut(own.groupBy("cls").agg(F.min(F.struct("kid", "kth")).alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("low").alias("low")), "classes")
    found = labels(classes, rows, words, similarity)
    labelled = classes.join(found, classes["cls"] == found["node"], "left").select("key", F.coalesce("component", "cls").alias("label"))
    chosen = labelled.groupBy("label").agg(F.min("key").alias("least")).select(F.col("least.kid").alias(key[0]), F.col("least.kth").alias(key[1]))
    return compact(keyed.join(chosen, key, "left_semi").dropDuplicates(key).select(*named(docs.columns)), docs)
