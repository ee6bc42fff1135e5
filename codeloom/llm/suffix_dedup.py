"""Exact removal of repeated byte strings, by common-prefix interval trees over enhanced suffix arrays.

A byte goes if some string of `size` bytes over it also starts anywhere else in the corpus. The corpus's suffixes are dealt
out by content: each window of `size` bytes belongs to its minimizer (superwindows.py), so equal windows meet in the group of
one minimizer, and a group needs only the suffixes that start at the minimizer. Runs of windows with equal content are
counted first; a run whose content comes twice is repeated as a whole, and copies go no further than the count. For the other
groups, one distinct text per run is fetched, and the group's suffixes are sorted with their common-prefix lengths. A
stack-scan of those gives the tree of intervals; inside an interval, the suffixes are put in order of what stands left of them,
and where the left extensions stop to agree, a maximal repeat ends. Every occurrence of every maximal repeat of at least
`size` bytes is marked, not only that of neighbours.

A group with more than GROUP different runs or SUFFIXES suffixes (a very frequent phrase in many contexts) is split before
it is given to tasks: its runs' contents are dealt out again in the same way with the anchors in another order, so windows meet by
another of their strings. What has not parted after LEVELS orders (no such group is known) is counted by window hashes in a
distributed sum. Contents are told apart by XXH64 within their minimizer's group; two different ones of a group of g runs are taken
as equal with odds of g * g / 2^65.

Passages can be counted in words instead of bytes: each word, and each character of scripts that are written without spaces, then
stands as CODE bytes.

Defined cases: null texts are empty; texts shorter than `size` keep all; equal rows repeat each other; rows with the same id
and other texts are told apart by the text's hash; texts of any length are read whole, CHUNK by CHUNK; an empty table gives an empty
result; other columns are not read, and none of their names clashes with those used here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_hexdigest

from codeloom.llm.common import arrow_rows, bound_batches, compact, cut, discard, fresh, named, with_key
from codeloom.llm.superwindows import ANCHOR, Hashes, anchors, runs
from codeloom.operators.joins import hot_join

SIZE = 400
#: Words of a passage, whatever its bytes: over 50.
WORDS = 51
#: Runs and suffixes that one task sorts together at most.
GROUP, SUFFIXES = 2048, 50_000
#: Orders of the anchors, and parts that a minimizer's runs are joined in.
LEVELS, SALTS = 4, 8
#: Bytes that stand for a word where passages are counted in words, words that are coded at a time, and characters of a word
#: beyond which it is long.
CODE, SLICE_WORDS, LONG_WORD = 4, 8192, 256
#: Characters of scripts without spaces: South-East Asian, Japanese, Chinese.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ALONE, UNIT = re.compile(f"[{_ALONE}]"), re.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of a suffix array, by a stack-scan of its common-prefix lengths: lcp[k] is
    shared by the suffixes of rank k and k + 1."""
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, k
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def neighbours(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of up to width bytes, and common-prefix lengths of neighbours in it."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), dtype=np.int64)
    grid = np.frombuffer(b"".join([strings[k].ljust(width, b"\0") for k in order]), dtype=np.uint8).reshape(-1, width)
    apart = grid[1:] != grid[:-1]
    shared = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    sizes = np.array([len(strings[k]) for k in order])
    return order, np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], size: int, left_most: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Groups of repeats of at least size bytes over suffixes with what stands left of them (reversed): (bytes right of the
    suffixes' start that all share, [(suffix, bytes left of it shared with some other of the group)])."""
    index = np.arange(len(rights))
    while len(index) > 1:
        right, depth = neighbours([rights[k] for k in index], size)
        left, agree = neighbours([lefts[k] for k in index], left_most)
        # no partner shares more than a neighbour in the order does
        best = np.zeros(len(index), dtype=np.int64)
        best[right] = np.maximum(np.append(depth, 0), np.insert(depth, 0, 0))
        widest = np.maximum(np.append(agree, 0), np.insert(agree, 0, 0))
        best[left] += widest
        stay = best >= size
        if stay.all():
            break
        index = index[stay]
    else:
        return
    rank = np.empty(len(left), dtype=np.int64)
    rank[left] = np.arange(len(left))
    # least of any range of `agree`, from tables of doubling spans
    spans = [agree]
    while 2 << (len(spans) - 1) <= len(agree):
        half = 1 << (len(spans) - 1)
        spans.append(np.minimum(spans[-1][:-half], spans[-1][half:]))
    levels = [len(x) for x in spans]
    starts = np.concatenate(([0], np.cumsum(levels)[:-1]))
    table = np.concatenate(spans)
    own_widest, sorted_rank = widest[rank[right]], rank[right]
    for d, first, last in intervals(depth.tolist()):
        if d + own_widest[first : last + 1].max() < size:
            continue
        own = np.sort(sorted_rank[first : last + 1])
        # left-extension diversity: what neighbours in left order share before they differ
        level = np.frexp(np.diff(own).astype(np.float64))[1] - 1
        between = np.minimum(table[starts[level] + own[:-1]], table[starts[level] + own[1:] - (1 << level)])
        if d + between.max() < size:
            continue
        longest = np.maximum(np.append(between, 0), np.insert(between, 0, 0))
        keep = np.flatnonzero(longest + d >= size)
        yield d, [(int(index[left[own[k]]]), int(longest[k])) for k in keep]


def repeated_windows(texts: list[bytes], minimizer: int, single: list[int], size: int, level: int = 0) -> dict[int, list[tuple[int, int]]]:
    """Text -> ranges (first, last) of windows that also start elsewhere in the group. single: the minimizer's only
    position in the text, or -1 if it has several. A window belongs to the first minimizer in it, so what stands left of a
    suffix ends before the minimizer that comes before."""
    known: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    for k, (text, p) in enumerate(zip(texts, single)):
        if p >= 0:
            at = [p]
        else:
            at = np.flatnonzero(anchors(np.frombuffer(text, dtype=np.uint8), level) == np.uint64(minimizer)).tolist()
        before = -1
        for p in at:
            left = text[max(before + 1, p - size + ANCHOR) : p][::-1]
            right = text[p : p + size]
            if len(left) + len(right) >= size:
                known.setdefault((right, left), []).append((k, p))
            before = p
    found: dict[int, list[tuple[int, int]]] = {}

    def mark(places: list[tuple[int, int]], shared: int, longest: int) -> None:
        for t, p in places:
            found.setdefault(t, []).append((p - longest, p - max(0, size - shared)))

    suffixes = list(known.items())
    for (right, left), places in suffixes:
        if len(places) > 1:  # the same on both sides: every window here is repeated
            mark(places, len(right), len(left))
    if len(suffixes) > 1:
        for d, group in maximal_repeats([x[0][0] for x in suffixes], [x[0][1] for x in suffixes], size, size - ANCHOR):
            for k, longest in group:
                if len(suffixes[k][1]) == 1:
                    mark(suffixes[k][1], d, longest)
    return {t: merged(x) for t, x in found.items()}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed ranges of integers."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def plain(text: str | None) -> bytes:
    return (text or "").encode()


def coded(text: str | None) -> bytes:
    """A text as CODE bytes for each of its words, so strings of bytes are strings of words whatever their length. A word's
    code is half of the 64-bit hash of its slice of the text; polynomial sums of long strings can collide, so a long word stands
    as its XXH64."""
    words, out = units(text or ""), []
    for k in range(0, len(words), SLICE_WORDS):
        part = words[k : k + SLICE_WORDS]
        if max(map(len, part)) > LONG_WORD:
            part = [w if len(w) <= LONG_WORD else "\0" + xxh64_hexdigest(w.encode("utf-8", "surrogatepass")) for w in part]
        data = np.frombuffer(" ".join(part).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        blanks = np.flatnonzero(data == 32)
        out.append((Hashes(data).slices(np.r_[0, blanks + 1], np.r_[blanks, len(data)]) >> np.uint64(32)).astype(">u4").tobytes())
    return b"".join(out)


def units(text: str) -> list[str]:
    """The words of a text; characters of scripts without spaces are words of their own."""
    return text.split() if text.isascii() or not ALONE.search(text) else UNIT.findall(text)


def _emitted(rows: DataFrame, size: int, code: Callable, level: int) -> DataFrame:
    def each(batch) -> dict:
        cols: dict[str, list] = {k: [] for k in ("kid", "kth", "m", "t", "s", "n", "times", "at")}
        for kid, kth, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = code(text.as_py())
            if len(data) < size:
                continue
            m, t, s, n, times, at = runs(data, size, level)
            cols["kid"].append(np.full(len(m), kid))
            cols["kth"].append(np.full(len(m), kth))
            for k, v in (("m", _signed(m)), ("t", _signed(t)), ("s", s), ("n", n), ("times", times), ("at", at)):
                cols[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in cols.items()}

    return arrow_rows(rows, ["kid", "kth", "text"], "kid long, kth long, m long, t long, s long, n int, times int, at int", each)


def _contents(rows: DataFrame, wanted: DataFrame, size: int, code: Callable) -> DataFrame:
    """(m, t, single, hot, content) of one text per run of `wanted`, fetched from its document."""
    lists = wanted.groupBy("kid", "kth").agg(F.collect_list(F.struct("m", "t", "single", "hot", "s", "n")).alias("x"))
    lists = lists.select("kid", "kth", *[F.col(f"x.{c}").alias(c) for c in ("m", "t", "single", "hot", "s", "n")])
    # equal rows share a key: each row is fetched once
    joined = rows.join(lists, ["kid", "kth"])

    def each(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("m", "t", "single", "hot", "content")}
        get = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        for row in range(len(batch)):
            data = code(get["text"][row].as_py())
            s, n = get["s"][row].as_py(), get["n"][row].as_py()
            for c in ("m", "t", "single", "hot"):
                out[c] += get[c][row].as_py()
            out["content"] += [data[a : a + b + size - 1] for a, b in zip(s, n)]
        return out

    return arrow_rows(joined, ["text", "m", "t", "single", "hot", "s", "n"], "m long, t long, single int, hot boolean, content binary", each)


def _tree_ranges(contents: DataFrame, size: int, level: int) -> DataFrame:
    """(m, t, first, last) from the interval trees of groups that fit one task."""
    import pandas as pd

    def solve(m: int, texts: list[bytes], t: list[int], single: list[int], out: list) -> None:
        unique = {v: k for k, v in enumerate(t)}
        keep = sorted(unique.values())
        for k, ranges in repeated_windows([texts[i] for i in keep], m % (1 << 64), [single[i] for i in keep], size, level).items():
            out += [(m, t[keep[k]], a, b) for a, b in ranges]

    def run(batches):
        held: tuple[int, list, list, list] | None = None
        for b in batches:
            out: list = []
            m, t, single, content = (b[c].tolist() for c in ("m", "t", "single", "content"))
            edges = np.flatnonzero(np.r_[True, b["m"].to_numpy()[1:] != b["m"].to_numpy()[:-1], True]) if len(b) else []
            for x, y in zip(edges[:-1], edges[1:]):
                if held and held[0] == m[x]:
                    held[1].extend(content[x:y])
                    held[2].extend(t[x:y])
                    held[3].extend(single[x:y])
                else:
                    if held:
                        solve(*held, out)
                    held = (m[x], content[x:y], t[x:y], single[x:y])
            yield pd.DataFrame(out, columns=["m", "t", "first", "last"])
        if held:
            out = []
            solve(*held, out)
            yield pd.DataFrame(out, columns=["m", "t", "first", "last"])

    dealt = contents.select("m", "t", "single", "content").repartition("m").sortWithinPartitions("m", "t")
    return dealt.mapInPandas(run, "m long, t long, first int, last int")


def _hashed_ranges(contents: DataFrame, size: int) -> DataFrame:
    """(m, t, first, last) of what no order of the anchors parts: windows are counted by hash, aggregated before the shuffle."""
    from xxhash import xxh64_intdigest

    def each(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("m", "t", "o", "w")}
        for m, t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = memoryview(c.as_py())
            w = np.array([xxh64_intdigest(data[k : k + size]) for k in range(len(data) - size + 1)], dtype=np.uint64)
            out["m"].append(np.full(len(w), m))
            out["t"].append(np.full(len(w), t))
            out["o"].append(np.arange(len(w)))
            out["w"].append(_signed(w))
        return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}

    windows = arrow_rows(contents, ["m", "t", "content"], "m long, t long, o int, w long", each).distinct()
    twice = windows.groupBy("m", "w").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    hit = windows.join(twice, ["m", "w"])
    return hit.select("m", "t", F.col("o").alias("first"), F.col("o").alias("last"))


#: Closed ranges of integers in an array `ranges`, united.
_UNION = """aggregate(array_sort(ranges), cast(array() AS array<struct<first:bigint,last:bigint>>), (done, x) ->
  CASE WHEN x.first <= try_element_at(done, -1).last + 1
  THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', try_element_at(done, -1).first, 'last', greatest(try_element_at(done, -1).last, x.last))))
  ELSE concat(done, array(named_struct('first', cast(x.first AS bigint), 'last', cast(x.last AS bigint)))) END)"""


def _repeats(rows: DataFrame, size: int, group: int, code: Callable, held: list[str], level: int = 0, last: int = LEVELS) -> DataFrame:
    """(kid, kth, a, b): ranges [a, b) of bytes to remove from rows (kid, kth, text), in any order and overlapping. held: gets
    the paths of the tables that the result reads."""
    emitted = cut(_emitted(rows, size, code, level), "windows", rows, held)
    grouped = emitted.groupBy("m", "t").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("kid", "kth", "s")).alias("of"), F.max("n").alias("n"), F.max("times").alias("times"), F.max("at").alias("at"))
    run = cut(grouped, "runs", held=held)  # read three times below
    # a group is open if it has several suffixes and not all its runs are known as copies
    groups = run.groupBy("m").agg(F.count(F.lit(1)).alias("runs"), F.sum("times").alias("suffixes"), F.min("copies").alias("least")).where("suffixes > 1 and least = 1")
    hot = ((F.col("runs") > group) | (F.col("suffixes") > SUFFIXES)).alias("hot")
    # a frequent minimizer's runs are joined in parts, so they are no hot key
    parts = groups.select("m", hot, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    single = F.when(F.col("times") == 1, F.col("at")).otherwise(-1)
    wanted = run.withColumn("part", F.pmod("t", F.lit(SALTS)).cast("int")).join(parts, ["m", "part"]).select("m", "t", single.alias("single"), "hot", "of.kid", "of.kth", "of.s", "n")
    contents = cut(_contents(rows, wanted, size, code), "contents", rows, held)
    ranges = _tree_ranges(contents.where("not hot"), size, level)
    if contents.where("hot").limit(1).count():
        large = contents.where("hot")
        if level + 1 < last:
            again = _repeats(large.select(F.col("m").alias("kid"), F.col("t").alias("kth"), F.col("content").alias("text")).dropDuplicates(["kid", "kth"]), size, group, bytes, held, level + 1, last)
            ranges = ranges.union(again.select("kid", "kth", "a", (F.col("b") - size).cast("int")))
        else:
            ranges = ranges.union(_hashed_ranges(large, size))
    whole = run.where("copies > 1").select("m", "t", F.lit(0).cast("long").alias("first"), (F.col("n") - 1).cast("long").alias("last"), "copies")
    both = whole.union(ranges.withColumn("copies", F.lit(1))).groupBy("m", "t").agg(F.collect_list(F.struct("first", "last")).alias("ranges"), F.max("copies").alias("copies"))
    # ranges that touch are one, so a run brings few however many other runs it meets; one that very many rows share is joined by
    # broadcast
    resolved = cut(both.withColumn("ranges", F.expr(_UNION)), "resolved", held=held)
    spans = hot_join(emitted.select("kid", "kth", "m", "t", "s"), resolved, ["m", "t"], "copies", emitted.count()).select("kid", "kth", "s", F.explode("ranges").alias("x"))
    return spans.select("kid", "kth", (F.col("s") + F.col("x.first")).alias("a"), (F.col("s") + F.col("x.last") + size).alias("b"))


def _span_lists(keyed: DataFrame, key: list[str], name: str, size: int, group: int, code: Callable = plain, levels: int = LEVELS) -> DataFrame:
    """(key, name): per row that loses bytes, arrays a and b of the ranges [a, b) to remove, in any order. It is written, and
    the tables behind it are deleted."""
    held: list[str] = []
    rows = keyed.select(F.col(key[0]).alias("kid"), F.col(key[1]).alias("kth"), "text")
    lists = _repeats(rows, size, group, code, held, last=levels).groupBy("kid", "kth").agg(F.collect_set(F.struct("a", "b")).alias("x"))
    out = cut(lists.select(F.col("kid").alias(key[0]), F.col("kth").alias(key[1]), F.struct(F.col("x.a").alias("a"), F.col("x.b").alias("b")).alias(name)), "spans")
    discard(keyed.sparkSession, held)
    return out


def repeated_spans(docs: DataFrame, size: int = SIZE, group: int = GROUP, levels: int = LEVELS, words: int | None = None) -> DataFrame:
    """(doc_id, text, spans) of every row: the maximal byte ranges [start, end) to remove, in order. Where words is given, passages
    too: the maximal byte ranges of whole words in which any `words` words come again in the same order, here or elsewhere,
    whatever their bytes and the white space between them."""
    keyed, key = with_key(docs.select("doc_id", "text"))
    lists, names = _span_lists(keyed, key, "spans", size, group, levels=levels), ["spans"]
    if words:
        lists, names = lists.join(_span_lists(keyed, key, "passages", CODE * words, group, coded, levels), key, "full"), ["spans", "passages"]
    joined = keyed.join(lists, key, "left")

    def each(batch) -> dict:
        out = {"doc_id": batch.column(0), "text": batch.column(1), "spans": [_spans(x["a"], x["b"]) if x else [] for x in batch.column(2).to_pylist()]}
        if words:
            found = zip(batch.column(1), batch.column(3).to_pylist())
            out["passages"] = [[{"start": a, "end": b} for a, b in word_ranges(text.as_py(), x["a"], x["b"])] if x else [] for text, x in found]
        return out

    return arrow_rows(joined, ["doc_id", "text", *names], "doc_id long, text string" + "".join(f", {n} array<struct<start:long,end:long>>" for n in names), each)


def _spans(a, b) -> list[dict]:
    return [{"start": x, "end": y + 1} for x, y in merged([(int(x), int(y) - 1) for x, y in zip(a, b)])]


def kept(data: bytes, spans: list[dict]) -> bytes:
    """What is left of data without the spans."""
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def word_ranges(text: str, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Byte ranges of a text for ranges of its coded bytes: the whole words that lie in them."""
    words = [m.span() for m in (UNIT if ALONE.search(text) else re.compile(r"\S+")).finditer(text)]
    data = None if text.isascii() else np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    # where each character begins
    ends = None if data is None else np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    out = []
    for s in _spans(a, b):
        first, last = -(-s["start"] // CODE), s["end"] // CODE - 1
        if first <= last:
            x, y = words[first][0], words[last][1]
            out.append((x, y) if ends is None else (int(ends[x]), int(ends[y])))
    return out


def without_repeats(docs: DataFrame, size: int = SIZE, group: int = GROUP, words: int | None = None) -> DataFrame:
    """The rows, with all their columns, without repeated strings in their text; n_chars is counted anew. Strings of at least
    `size` bytes go and, where it is given, passages of at least `words` words, whatever their bytes. A character that loses some
    of its bytes goes; a row that loses something and has only white space left goes."""
    (keyed, key), names = with_key(docs), docs.columns
    own = fresh(keyed, "spans", "passages")
    lists = _span_lists(keyed, key, own[0], size, group)
    if words:
        lists = lists.join(_span_lists(keyed, key, own[1], CODE * words, group, coded), key, "full")
    # columns travel by their place, since a name may hold what a Python function's input cannot
    places = [f"c{k}" for k in range(len(names))]
    joined = keyed.join(lists, key, "left").select(*[c.alias(p) for c, p in zip(named(names), places)], *own[: 2 if words else 1])
    schema = StructType([StructField(p, f.dataType) for p, f in zip(places, docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, marks = {n: b.column(k) for k, n in enumerate(names)}, [b.column(k) for k in range(len(names), b.num_columns)]
            texts, keep = own["text"].to_pylist(), np.ones(len(b), dtype=bool)
            counts = own["n_chars"].to_pylist() if "n_chars" in own else None
            hit = np.any([np.asarray(m.is_valid()) for m in marks], axis=0)
            for k in np.flatnonzero(hit).tolist():
                spans, *passages = (m[k].as_py() for m in marks)
                found = list(zip(spans["a"], spans["b"])) if spans else []
                for x in passages:
                    found += word_ranges(texts[k], x["a"], x["b"]) if x else []
                if not found:
                    continue
                texts[k] = kept(texts[k].encode(), _spans(*zip(*found))).decode("utf-8", "ignore")
                keep[k] = bool(texts[k].strip())
                if counts:
                    counts[k] = len(texts[k])
            own["text"] = pa.array(texts, type=own["text"].type)
            if counts:
                own["n_chars"] = pa.array(counts, type=own["n_chars"].type)
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names=places).filter(pa.array(keep))

    bound_batches(docs.sparkSession)
    return compact(joined.mapInArrow(run, schema), docs).toDF(*names)
