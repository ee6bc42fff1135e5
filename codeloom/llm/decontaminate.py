"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, names (capitalised words inside a sentence) and units after a number, or in one
word with it, are typed placeholders. A capitalised word that begins a sentence may be a name or not: both forms of the windows
around it are compared. Windows of WORDS template tokens of the benchmark are hash-joined with those of every document. An item is
found in a document if, in one region of it, at least SIMILARITY of its windows are there and the slots are consistent: one value
of the item stands for one value of the document, so a question with other numbers or names is caught, and a chance mix of
placeholders is not. All places of a window count, so a variant before a copy does not hide it; windows scattered over a long
text are in no one region and do not add up.

Items without a window of LITERALS literal tokens (fewer than WORDS tokens, or almost placeholders alone) have no template to
speak of. They are joined by their tokens' own values: windows of WORDS tokens, or the whole sequence where it is shorter, and an
item of a single token by documents of that token alone.

The benchmark is a query set: its windows are dealt into blocks of at most BLOCK windows, and every document is compared with every
block. The build side of the join, a block's windows sorted by hash, is broadcast; documents probe it in vectors. No document is
gathered or shuffled. The driver holds one block at a time: with several, what each finds is written to the shared folder.

Defined cases: null and empty texts match nothing, as item or as document; items with equal texts are each found; equal documents
are each reported; texts of any length are read whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from codeloom.llm.common import arrow_rows, cut, text_udf

WORDS = 5
SIMILARITY = 0.8
#: Literal tokens that a window needs, and share of slot values that must be mapped one to one.
LITERALS, CONSISTENT = 2, 0.8
#: Windows of the benchmark that are broadcast at a time (about 100 bytes each, with their items).
BLOCK = 1_000_000

NUMBER, NAME, UNIT = 1, 2, 3
UPPER, ENDS = 4, 8
NUMERIC = re.compile(r"[+-]?\d[\d.,:/%-]*")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million half twice".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams ton tons pound pounds ounce ounces l ml liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts".split())
#: A number with its unit in one word.
GLUED = re.compile(r"([+-]?\d[\d.,:/]*)-?([a-zA-Z]+)")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Lexicon:
    """Raw word -> row of `values` and `traits`: the hash of the bare lower-case word, and its kind plus UPPER if it is capitalised
    plus ENDS if it ends a sentence. Row 0 is for words without letters or digits; -k - 1 stands for the rows `pairs[k]` of a
    number and its unit in one word. Words met last are kept."""

    MOST = 300_000

    def __init__(self):
        self._restart()

    def _restart(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs: list[tuple[int, int]] = []
        self.values, self.traits = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.int8)
        self.n = 1

    def _add(self, raw: str) -> int:
        a, b = 0, len(raw)
        while a < b and not raw[a].isalnum():
            a += 1
        while b > a and not raw[b - 1].isalnum():
            b -= 1
        bare = raw[a:b]
        if not bare:
            self.known[raw] = 0
            return 0
        low = bare.lower()
        if bare[0].isdigit() and (glued := GLUED.fullmatch(bare)) and glued[2].lower() in UNITS:
            self.pairs.append(tuple(self.known.get(w) or self._add(w) for w in (raw[: a + glued.end(1)], raw[a + glued.start(2) :])))
            self.known[raw] = -len(self.pairs)
            return self.known[raw]
        kind = UNIT if low in UNITS else NUMBER if low in NUMBER_WORDS or (not low.isalpha() and NUMERIC.fullmatch(bare)) else 0
        data = low.encode("utf-8", "surrogatepass")
        if self.n == len(self.values):
            self.values, self.traits = np.concatenate((self.values, np.zeros_like(self.values))), np.concatenate((self.traits, np.zeros_like(self.traits)))
        self.values[self.n] = xxh64_intdigest(data) & 0x7FFFFFFFFFFFFFFF | 16
        self.traits[self.n] = kind + (UPPER if bare[0].isupper() and bare[1:].islower() else 0) + (ENDS if raw[-1] in ".!?:;\"”»" else 0)
        self.known[raw] = self.n
        self.n += 1
        return self.n - 1

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.MOST:
            self._restart()
        x = list(map(self.known.get, words))
        if None in x:
            for k, w in enumerate(words):
                if x[k] is None:
                    got = self.known.get(w)
                    x[k] = self._add(w) if got is None else got
        rows = np.array(x, dtype=np.int64)
        if len(rows) and rows.min() < 0:
            rows = np.array([r for k in x for r in ((k,) if k >= 0 else self.pairs[-k - 1])], dtype=np.int64)
        return rows[rows > 0]


def canonical(text: str, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens (a placeholder's number or a word's hash), beside them each token's own value, and the tokens with
    capitalised words at the start of a sentence read as names too."""
    rows = lexicon.rows(text.split())
    value, traits = lexicon.values[rows], lexicon.traits[rows]
    if not len(rows):
        return value, value, value
    kind, token = traits & 3, value.copy()
    token[kind == NUMBER] = NUMBER
    units = np.flatnonzero(kind == UNIT)
    token[units[(units > 0) & (kind[units - 1] == NUMBER)]] = UNIT
    names = np.flatnonzero((traits & (UPPER | 3)) == UPPER)
    other = token.copy()
    other[names] = NAME
    token[names[(names > 0) & (traits[names - 1] & ENDS == 0)]] = NAME
    return token, value, other


def windows(token: np.ndarray, words: int = WORDS, literals: int = LITERALS) -> np.ndarray:
    """A hash of every window; 0 for those with too few literal tokens."""
    n = len(token) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, words, dtype=np.uint64)
    literal = np.zeros(n, dtype=np.int64)
    for k in range(words):
        t = token[k : k + n]
        h = (h ^ t) * _MULTIPLIER
        h ^= h >> np.uint64(29)
        if literals:
            literal += t > 3
    h[h == 0] = 1
    if literals:
        h[literal < literals] = 0
    return h


def consistent(pairs: list[tuple[int, int, int]]) -> bool:
    """pairs: (kind, item's value, document's value) of aligned slots. Most must follow one one-to-one mapping."""
    if not pairs:
        return True
    forth: dict[tuple, dict[int, int]] = {}
    back: dict[tuple, dict[int, int]] = {}
    for kind, a, b in pairs:
        for d, x, y in ((forth, a, b), (back, b, a)):
            seen = d.setdefault((kind, x), {})
            seen[y] = seen.get(y, 0) + 1
    agree = lambda d: sum(max(v.values()) for v in d.values())
    return min(agree(forth), agree(back)) >= CONSISTENT * len(pairs)


def regions(places: list[tuple[int, int]], least: float, slack: int) -> Iterator[dict[int, int]]:
    """Ways to place at least `least` of an item's windows in one region of a document, window -> place, from all
    (window, place) found: the alignments (place less window) by the windows that they hold, each alone and then with windows
    moved by at most `slack`, the nearest place each."""
    lines: dict[int, list[int]] = {}
    for i, d in places:
        lines.setdefault(d - i, []).append(i)
    order, seen = sorted(lines), set()
    for o in sorted(lines, key=lambda o: (-len(lines[o]), o)):
        near = order[bisect_left(order, o - slack) : bisect_right(order, o + slack)]
        for group in ([o], sorted(near, key=lambda x: (abs(x - o), x))):
            if sum(len(lines[x]) for x in group) < least:
                continue
            where: dict[int, int] = {}
            for x in group:
                for i in lines[x]:
                    where.setdefault(i, x + i)
            if len(where) >= least and (key := tuple(sorted(where.items()))) not in seen:
                seen.add(key)
                yield where


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Items (item_id, tokens, values, tokens with names at starts) in blocks of at most about `block` windows, one block at a
    time on the driver."""
    lexicon = Lexicon()

    def each(batch) -> dict:
        made = [canonical(t.as_py() or "", lexicon) for t in batch.column(1)]
        return {"item_id": batch.column(0)} | {name: [x[k].view(np.int64) for x in made] for k, name in enumerate(("tokens", "vals", "others"))}

    items = arrow_rows(benchmark, ["item_id", "text"], "item_id long, tokens array<long>, vals array<long>, others array<long>", each)
    held, n = [], 0
    for r in items.where(F.size("tokens") > 0).toLocalIterator():
        if held and n + len(r["tokens"]) > block:
            yield held
            held, n = [], 0
        held.append((r["item_id"], *[np.array(r[c], dtype=np.int64).view(np.uint64) for c in ("tokens", "vals", "others")]))
        n += len(r["tokens"])
    if held:
        yield held


def _index(items: list[tuple]) -> dict:
    """The build side: windows sorted by hash with their item, position and form (1: only with names at starts)."""
    hashes, owner, position, form, widths, forms = [], [], [], [], set(), []
    need = np.zeros(len(items), dtype=np.int64)
    for k, (_, token, value, other) in enumerate(items):
        h, g = windows(token), windows(other)
        width = WORDS
        if not h.any():  # no template: the tokens' own values
            width = min(WORDS, len(value))
            token = other = value
            h = g = windows(value, width, 0)
            widths.add(width)
        forms.append((token, other, value, width))
        need[k] = np.count_nonzero(h)
        for n, (x, at) in enumerate(((h, np.flatnonzero(h)), (g, np.flatnonzero((g != 0) & (g != h))))):
            hashes.append(x[at])
            owner.append(np.full(len(at), k))
            position.append(at)
            form.append(np.full(len(at), n))
    h, o, p, f = (np.concatenate(x) for x in (hashes, owner, position, form))
    order = np.argsort(h, kind="stable")
    return {"hash": h[order], "owner": o[order], "at": p[order], "form": f[order], "need": need, "forms": forms, "widths": sorted(widths)}


def _finder(docs: DataFrame, items: list[tuple], similarity: float):
    """A function text -> [(item, windows, similarity, changed slots)], with the block of items broadcast."""
    held, lexicon = docs.sparkSession.sparkContext.broadcast(_index(items)), Lexicon()

    def found(text: str) -> list[tuple]:
        x = held.value
        token, value, other = canonical(text, lexicon)
        w, v = windows(token), windows(other)
        also = np.flatnonzero((v != 0) & (v != w))
        w, place = [w, v[also]], [np.arange(len(w)), also]
        for width in x["widths"]:
            if width > 1 or len(value) == 1:
                w.append(windows(value, width, 0))
                place.append(np.arange(len(w[-1])))
        w, place = np.concatenate(w), np.concatenate(place)
        lo = np.searchsorted(x["hash"], w, side="left")
        at = np.flatnonzero((w != 0) & (lo < len(x["hash"])))
        at = at[x["hash"][lo[at]] == w[at]]
        if not len(at):
            return []
        # (window, place) -> whether only the form with names at starts is there
        hits: dict[int, dict[tuple[int, int], int]] = {}
        for a in at.tolist():
            k, d = int(lo[a]), int(place[a])
            while k < len(x["hash"]) and x["hash"][k] == w[a]:
                of, pair, form = hits.setdefault(int(x["owner"][k]), {}), (int(x["at"][k]), d), int(x["form"][k])
                of[pair] = min(form, of.get(pair, 1))
                k += 1
        out = []
        for k, places in hits.items():
            least = similarity * x["need"][k]
            if len({i for i, _ in places}) < least:
                continue
            *forms, own, width = x["forms"][k]
            for where in regions(list(places), least, len(own) // 4 + WORDS):
                slots = {(i + j, d + j) for i, d in where.items() for j in range(width) if forms[places[i, d]][i + j] <= 3}
                if consistent([(int(forms[1][i]), int(own[i]), int(value[d])) for i, d in slots]):
                    changed = sum(own[i] != value[d] for i, d in slots)
                    out.append((k, len(where), float(len(where) / x["need"][k]), int(changed)))
                    break
        return out

    return found


SCHEMA = "doc_id long, item_id long, n_windows long, similarity double, n_changed_slots long"


def _match(docs: DataFrame, items: list[tuple], similarity: float) -> DataFrame:
    found, ids = _finder(docs, items, similarity), [i for i, *_ in items]

    def each(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "n_windows", "similarity", "n_changed_slots")}
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            for k, n, s, c in found(t.as_py() or ""):
                for name, v in zip(out, (doc, ids[k], n, s, c)):
                    out[name].append(v)
        return out

    return arrow_rows(docs, ["doc_id", "text"], SCHEMA, each)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_windows, similarity, n_changed_slots) of every benchmark item found in a document."""
    blocks = _blocks(benchmark, block)
    items, out = next(blocks, None), None
    while items:
        after = next(blocks, None)
        found = _match(docs, items, similarity)
        if out is not None or after:
            found = cut(found, "found")
        out, items = found if out is None else out.unionByName(found), after
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows, with all their columns, in which no benchmark item is found."""
    blocks = _blocks(benchmark, block)
    items = next(blocks, None)
    while items:
        found, after = _finder(docs, items, similarity), next(blocks, None)
        docs = docs.where(text_udf(docs.sparkSession, "boolean", lambda text, found=found: not found(text or ""))("text"))
        docs, items = cut(docs, "clean", docs) if after else docs, after
    return docs
