"""Quality rules: base rules, then logistic regression on hashed word and character n-grams.

Words, word pairs and character triples of the text as it stands are hashed to DIMS dimensions. The regression is fitted on a
bounded sample of labelled rows (PER_CLASS a label, at most DIMS features each), its scores are calibrated to probabilities on rows held out of the fit,
and whole texts are scored in Arrow batches against fixed thresholds.

Defined cases: null texts have no words and fail the base rules; a text of any length is read whole; without labels of both
classes the base rules alone decide; equal texts get equal answers; rows of the sample are put in order by their label and features,
so equal ones are interchangeable; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm.common import arrow_rows
from codeloom.llm.linear import platt, sigmoid, sparse_logistic
from codeloom.llm.samples import labelled

BITS = 16
DIMS = 1 << BITS
PER_CLASS = 1500
#: Fixed thresholds: fewest words, share in per cent of words in repeated windows, window, least probability of good.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW, LEAST_GOOD = 20, 30, 8, 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """Word -> hash, kept for the words met last."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str, words: list[str], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values, of unit length, of a text's hashed n-grams."""
    w = np.array([ids[x] for x in words], dtype=np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    keys = [w + np.uint64(1 << 40)]
    if len(w) > 1:
        keys.append(w[:-1] * np.uint64(0x100000001B3) + w[1:])
    if len(c) > 2:
        keys.append((c[:-2] << np.uint64(42)) + (c[1:-1] << np.uint64(21)) + c[2:] + np.uint64(1 << 63))
    hashed = (np.concatenate(keys) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)
    counts = np.bincount(hashed, minlength=DIMS)
    dims = np.flatnonzero(counts)
    x = 1 + np.log(counts[dims])
    return dims, x / max(1e-12, float(np.sqrt((x * x).sum())))


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first included. Windows are told apart
    exactly, by naming pairs of ever longer parts."""
    n = len(words)
    if n <= window:
        return 0
    names: dict[str, int] = {}
    x = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    span = 1
    while span < window:
        step = min(span, window - span)
        x = np.unique(x[:-step] * (int(x.max()) + 1) + x[step:], return_inverse=True)[1]
        span += step
    twice = np.bincount(x)[x] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base(text: str) -> tuple[list[str], int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated windows."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return words, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """The calibrated model, or None without rows of both classes."""
    ids = WordIds()

    def each(batch) -> dict:
        out = {"label": batch.column(1), "dims": [], "values": []}
        for t in batch.column(0):
            text = t.as_py() or ""
            d, x = features(text, WORD.findall(text), ids)
            out["dims"].append(d.astype(np.int32))
            out["values"].append(x.astype(np.float32))
        return out

    rows, sizes = labelled(docs, labels, "quality", per_class)
    if not sizes.get(0) or not sizes.get(1):
        return None
    got = arrow_rows(rows, ["text", "label"], "label int, dims array<int>, values array<float>", each).toArrow()
    made = sorted(((np.asarray(d.values, dtype=np.int64), np.asarray(v.values, dtype=np.float64), y) for d, v, y in zip(got.column("dims"), got.column("values"), got.column("label").to_pylist())), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # a total order
    order = np.random.default_rng(11).permutation(len(made))
    fold = lambda keep: [made[k] for n, k in enumerate(order) if keep(n)]
    train, held = fold(lambda n: n % 4), fold(lambda n: not n % 4)
    w, b = sparse_logistic([r[:2] for r in train], np.array([r[2] for r in train], dtype=float), DIMS)
    slope, offset = platt(np.array([r[1] @ w[r[0]] + b for r in held]), np.array([r[2] for r in held], dtype=float))
    # the sample holds the classes evenly; the offset turns that into their true shares
    have = {c: sum(r[2] == c for r in made) for c in (0, 1)}
    offset += float(np.log(sizes[1] / sizes[0]) - np.log(max(1, have[1]) / max(1, have[0])))
    return {"weights": w, "bias": b, "slope": slope, "offset": offset}


def judge(docs: DataFrame, model: dict | None, least_good: float = LEAST_GOOD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the probability of good of every whole text."""
    held, ids = docs.sparkSession.sparkContext.broadcast(model), WordIds()

    def each(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")}
        m = held.value
        for t in batch.column(1):
            text = t.as_py() or ""
            words, chars, symbols, lines, repeats = base(text)
            failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
            good = 1.0
            if m:
                d, x = features(text, words, ids)
                good = float(sigmoid(m["slope"] * (x @ m["weights"][d] + m["bias"]) + m["offset"]))
            for k, v in zip(out, (len(words), chars, symbols, lines, repeats, failed, not failed and good >= least_good, good)):
                out[k].append(v)
        return {"doc_id": batch.column(0)} | out

    return arrow_rows(docs, ["doc_id", "text"], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, good double", each)
