"""Toxicity: Levenshtein automata intersected with a lexicon trie, then scores of the hits' context windows.

The lexicon is mined from labelled rows: words and word beginnings (stems, which stand for their inflected forms) that occur
mostly in toxic rows, each with its log-odds, held as tries. The Levenshtein automata of all terms that occur almost only there
run on their trie at once: a state is the set of (node, edits so far) that a word's letters can have reached, states are made when
first met and kept, so most words end in the dead state after a few steps. Stems are matched exactly, words with one edit from FUZZY_1 letters on and two from
FUZZY_2 on.

Every hit is then judged in a window of CONTEXT words: quotation marks around it or words of reporting set quotation apart from
abuse. A logistic regression on counts of hits by kind gives the score. Lexicon and regression are fitted on a bounded sample
of labelled rows (PER_CLASS a label).

Defined cases: null and empty texts have no hits and the score of texts without any; equal texts get equal scores; texts of
any length are read whole; without toxic rows the lexicon is empty and every score is 0; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, cut
from codeloom.llm.linear import logistic, sigmoid
from codeloom.llm.samples import labelled

PER_CLASS = 2000
#: Toxic rows that a term needs in the sample, and its least share of toxic rows to be kept and to enter the trie. The bounded
#: sample bounds the terms.
LEAST_ROWS, LEANING, PURITY = 4, 0.6, 0.95
STEM_FROM, STEM_TO = 4, 7
FUZZY_1, FUZZY_2 = 5, 9
CONTEXT = 6
THRESHOLD = 0.3
# fixed values: marks and words that report speech, in the languages of the corpus
QUOTES = frozenset("\"'“”„«»‘’‚`")
REPORTING = frozenset("said says say called calls quote quoted quotes word term wrote sagte sagt nannte wort zitat dit disait appelé mot citation dijo dice llamó palabra cita".split())


class Trie:
    """Lexicon trie; a node is a number. ends: node -> edits that the term ending there allows; stems: nodes that end a
    stem."""

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: set[int] = set()
        self.odds: dict[int, float] = {}
        for w in words:
            self.ends[self._add(w)] = 0 if len(w) < FUZZY_1 else 1 if len(w) < FUZZY_2 else 2
        for w in stems:
            self.stems.add(self._add(w))
        # most edits that any term below a node allows
        self.budget = [self.ends.get(k, 0) for k in range(len(self.next))]
        for k in range(len(self.next) - 1, -1, -1):
            for child in self.next[k].values():
                self.budget[k] = max(self.budget[k], self.budget[child])

    def _add(self, word: str) -> int:
        at = 0
        for c in word:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
            at = self.next[at][c]
        return at


def graded(words: dict[str, float], stems: dict[str, float]) -> tuple[Trie, Trie]:
    """The lexicon's words and stems as tries whose ends have the log-odds."""
    out = Trie(list(words), []), Trie([], list(stems))
    for trie, terms in zip(out, (words, stems)):
        for t, odds in terms.items():
            trie.odds[trie._add(t)] = odds
    return out


def walk(trie: Trie, word: str) -> tuple[float | None, float | None]:
    """Log-odds of the whole word, and of the longest term of the trie that begins it; None where there is none."""
    at, longest = 0, None
    for c in word:
        at = trie.next[at].get(c, -1)
        if at < 0:
            return None, longest
        longest = trie.odds.get(at, longest)
    return trie.odds.get(at), longest


class Automaton:
    """The union of the terms' Levenshtein automata, intersected with their trie and made deterministic as it is used."""

    MOST_STATES = 50_000

    def __init__(self, trie: Trie):
        self.trie = trie
        self._reset()

    def _reset(self) -> None:
        self.moves: dict[tuple[int, str], int] = {}
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.at_end: list[int] = []
        self.stem: list[bool] = []
        self._state(())  # the dead state is 0
        self.start = self._state(self._close({0: 0}))

    def _close(self, best: dict[int, int]) -> tuple:
        """Adds what is reached by leaving out letters of a term; keeps the least edits of each node within its budget."""
        todo = list(best)
        while todo:
            node = todo.pop()
            for child in self.trie.next[node].values():
                e = best[node] + 1
                if e <= self.trie.budget[child] and e < best.get(child, 9):
                    best[child] = e
                    todo.append(child)
        return tuple(sorted(best.items()))

    def _state(self, items: tuple) -> int:
        if items not in self.number:
            self.number[items] = len(self.sets)
            self.sets.append(items)
            fits = [e for n, e in items if e <= self.trie.ends.get(n, -1)]
            self.at_end.append(min(fits, default=9))
            self.stem.append(any(e == 0 and n in self.trie.stems for n, e in items))
        return self.number[items]

    def _step(self, state: int, letter: str) -> int:
        best: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.trie.budget[node] and edits < best.get(node, 9):
                best[node] = edits

        for node, edits in self.sets[state]:
            put(node, edits + 1)  # a letter too many
            for c, child in self.trie.next[node].items():
                put(child, edits + (c != letter))
        # an exact path has no edits and so fits any budget
        return self._state(self._close(best))

    def distance(self, word: str) -> int:
        """Least edits to a term, 0 for a word that a stem begins, 9 if no term is near."""
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state = self.start
        for c in word:
            move = self.moves.get((state, c))
            if move is None:
                move = self.moves[state, c] = self._step(state, c)
            state = move
            if not state:
                return 9
            if self.stem[state]:
                return 0
        return self.at_end[state]


class Hits(dict):
    """Raw word -> (least edits to a term of the trie or 9, log-odds of the word or of its longest known stem) or None if
    neither speaks for toxicity; kept for the words met last."""

    MOST = 200_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], pure: tuple[list[str], list[str]]):
        super().__init__()
        self.graded = graded(words, stems)
        self.automaton = Automaton(Trie(*pure))

    def odds(self, word: str) -> float:
        own, _ = walk(self.graded[0], word)
        _, stem = walk(self.graded[1], word)
        return own if own is not None else stem or 0.0

    def __missing__(self, raw: str):
        if len(self) >= self.MOST:
            self.clear()
        word = bare(raw)
        e, odds = self.automaton.distance(word), self.odds(word)
        self[raw] = value = ((e, odds) if e < 9 or odds > 0 else None)
        return value


def bare(raw: str) -> str:
    a, b = 0, len(raw)
    while a < b and not raw[a].isalnum():
        a += 1
    while b > a and not raw[b - 1].isalnum():
        b -= 1
    return raw[a:b]


def quoted(words: list[str], k: int) -> bool:
    """Whether the window around word k quotes: the word stands between marks, or a word of reporting is near and a mark."""
    if words[k][0] in QUOTES and words[k].rstrip(".,!?;:")[-1:] in QUOTES:
        return True
    near = words[max(0, k - CONTEXT) : k + CONTEXT + 1]
    before = any(w[0] in QUOTES for w in words[max(0, k - CONTEXT) : k + 1])
    after = any(w.rstrip(".,!?;:")[-1:] in QUOTES for w in words[k : k + CONTEXT + 1])
    return (before and after) or ((before or after) and any(bare(w) in REPORTING for w in near))


FEATURES = 8


def features(text: str | None, hits: Hits) -> list[float]:
    """Logarithms of unquoted hits by edits, whether any is exact, of quoted hits, density, largest and summed log-odds."""
    words = (text or "").lower().split()
    found = [k for k, w in enumerate(words) if hits[w]]
    if not found:
        return [0.0] * FEATURES
    count, quotes, odds = [0, 0, 0], 0, []
    for k in found:
        e, weight = hits[words[k]]
        if e < 9 and quoted(words, k):
            quotes += 1
            continue
        if e < 9:
            count[e] += 1
        odds.append(weight)
    return [*(float(np.log1p(c)) for c in count), float(count[0] > 0), float(np.log1p(quotes)), sum(count) / len(words), max(odds, default=0.0), float(np.log1p(sum(odds)))]


def mine(rows: DataFrame, least: int = LEAST_ROWS) -> dict:
    """Words and stems, with log-odds, that lean to toxic rows of a balanced sample (text, label), and the pure ones."""

    def each(batch) -> dict:
        out: dict[str, list] = {"term": [], "label": []}
        for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
            words = {bare(w) for w in (t.as_py() or "").lower().split()}
            words = {w for w in words if len(w) >= 3 and any(c.isalpha() for c in w)}
            terms = {"w" + w for w in words} | {"s" + w[:n] for w in words for n in range(STEM_FROM, min(STEM_TO, len(w)) + 1)}
            out["term"] += terms
            out["label"] += [y] * len(terms)
        return out

    terms = arrow_rows(rows, ["text", "label"], "term string, label int", each).groupBy("term").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    kept = terms.where((F.col("toxic") >= least) & (F.col("toxic") >= LEANING * F.col("n"))).collect()
    odds = {r["term"]: float(np.log((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5))) for r in kept}
    pure = sorted((r["term"] for r in kept if r["toxic"] >= PURITY * r["n"]), key=lambda t: (len(t), t))
    stems: list[str] = []
    for t in pure:
        if t[0] == "s" and not any(t[1:].startswith(x) for x in stems):
            stems.append(t[1:])
    of = lambda kind: {t[1:]: v for t, v in odds.items() if t[0] == kind}
    return {"words": of("w"), "stems": of("s"), "pure": ([t[1:] for t in pure if t[0] == "w"], stems)}


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS) -> dict | None:
    """The lexicon from three fifths of the sample, the regression from the rest."""
    rows, sizes = labelled(docs, labels, "toxic", per_class, usable)
    if not sizes.get(1):
        return None
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5))), "toxic-sample")
    lexicon = mine(rows.where("part < 3"))
    hits = Hits(**lexicon)

    def each(batch) -> dict:
        return {"x": [features(t.as_py(), hits) for t in batch.column(0)], "label": batch.column(1)}

    got = arrow_rows(rows.where("part >= 3"), ["text", "label"], "x array<double>, label int", each).toArrow()
    if not len(got):
        return None
    x, y = np.array(got.column("x").to_pylist()), np.array(got.column("label").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))
    weights = logistic(x[order], y[order], l2=0.1)
    have = max(1.0, y.sum()) / max(1.0, (1 - y).sum())
    weights[-1] += np.log(sizes[1] / max(1, sizes.get(0, 0))) - np.log(have)
    return {"lexicon": lexicon, "weights": weights}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every whole text."""
    held, made = docs.sparkSession.sparkContext.broadcast(model), {}

    def each(batch) -> dict:
        m = held.value
        if not m:
            return {"doc_id": batch.column(0), "score": [0.0] * len(batch)}
        if "hits" not in made:
            made["hits"] = Hits(**m["lexicon"])
        x = np.array([features(t.as_py(), made["hits"]) for t in batch.column(1)]).reshape(len(batch), FEATURES)
        return {"doc_id": batch.column(0), "score": sigmoid(x @ m["weights"][:-1] + m["weights"][-1])}

    return arrow_rows(docs, ["doc_id", "text"], "doc_id long, score double", each)
