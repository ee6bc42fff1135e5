"""URL filters: given host and path rules, then association rules mined from labelled URLs.

A given rule fits its host and all subdomains if the path starts with the rule's; the longest wins. For URLs that no given
rule fits, Spark's FP-growth mines combinations of URL tokens that occur with the label of bad pages, on half the labelled URLs.
Rules are pruned by support (a share of the rows and LEAST_ROWS of them), confidence and lift; then each is counted on the other
half and stays only if the lower confidence limit of its precision there is above the share of bad pages, so what goes with the
label by chance goes again. Rules are matched by an inverted index from each rule's rarest token. Both rule sets are broadcast
behind a check of their size (MOST_GIVEN, MOST_MINED), beyond which an error asks for a higher support; URLs are judged row by row
without a shuffle.

Defined cases: null URLs and those without `://` have empty host and path, no tokens and no rule, and are allowed; ties
between given rules of one length go to the longer host; equal rows get equal answers; without labels nothing is mined; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, cut

ALLOW, BLOCK = "allow", "block"
BAD = "label=bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.5
#: Labelled rows that hold a rule, in the mined half and in the other, and standard deviations of the confidence limit.
LEAST_ROWS, LIMIT = 5, 3.0
MOST_GIVEN, MOST_MINED = 100_000, 5_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(host: str, path: str, url: str | None) -> list[str]:
    """Typed tokens of a URL: top-level name, host labels and their parts, path segments (numbers as one), query names."""
    out = set()
    labels = host.split(".") if host else []
    if labels:
        out.add(f"top:{labels[-1]}")
    for x in labels[:-1]:
        out.add(f"host:{x}")
        out.update(f"part:{y}" for y in re.split(r"[-_\d]+", x) if y and y != x)
    for x in path.split("/"):
        if x:
            out.add("path:" + re.sub(r"\d+", "0", x))
    if url and "?" in url:
        out.update("query:" + x.split("=")[0] for x in url.split("?", 1)[1].split("#")[0].split("&") if x)
    return sorted(out)


def lower_limit(hits: int, n: int, z: float = LIMIT) -> float:
    """Lower limit of Wilson's interval for a share of hits in n rows."""
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def matching(own: set[str], index: dict[str, list[tuple[frozenset, int]]]) -> list[int]:
    """Numbers of the rules whose tokens are all among a URL's."""
    return [k for t in own if t in index for s, k in index[t] if s <= own]


def mine(urls: DataFrame, bad: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, least_rows: int = LEAST_ROWS, limit: float = LIMIT) -> list[tuple[list[str], float]]:
    """Token sets that mark bad URLs, with their precision on the half that they were not mined from. urls: (id, url); bad: (id,
    bad boolean)."""
    from pyspark.ml.fpm import FPGrowth

    host, path = host_and_path(F.col("url"))
    known = urls.join(bad.groupBy("id").agg(F.max("bad").alias("bad")), "id").select("id", "url", host.alias("host"), path.alias("path"), "bad")

    def each(batch) -> dict:
        rows = [c.to_pylist() for c in batch.columns]
        return {"half": rows[0], "bad": rows[4], "items": [tokens(h, p, u) + ([BAD] if b else []) for u, h, p, b in zip(*rows[1:])]}

    half = F.pmod(F.xxhash64("id", F.lit("rule halves")), F.lit(2)).cast("int").alias("half")
    baskets = cut(arrow_rows(known.select(half, "url", "host", "path", "bad"), ["half", "url", "host", "path", "bad"], "half int, bad boolean, items array<string>", each), "baskets")
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("int"))).first()
    first = baskets.where("half = 0")
    n_first = first.count()
    if not n_bad or not n_first:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, least_rows / n_first)), minConfidence=min_confidence).fit(first)
    good = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    rows = good.select("antecedent", "confidence").limit(MOST_MINED + 1).collect()
    if len(rows) > MOST_MINED:
        raise ValueError("too many rules to broadcast: raise the support")
    # a longer rule says no more than a shorter one with at least its confidence
    kept: list[tuple[list[str], float]] = []
    for r in sorted(rows, key=lambda r: (len(r["antecedent"]), sorted(r["antecedent"]))):
        own = set(r["antecedent"])
        if not any(set(s) <= own and c >= r["confidence"] for s, c in kept):
            kept.append((sorted(own), r["confidence"]))
    if not kept:
        return []
    held = baskets.sparkSession.sparkContext.broadcast(inverted(kept))

    def count(batch) -> dict:
        found = [matching(set(x), held.value) for x in batch.column(1).to_pylist()]
        return {"bad": [b for b, f in zip(batch.column(0).to_pylist(), found) for _ in f], "rule": [k for f in found for k in f]}

    seen = arrow_rows(baskets.where("half = 1"), ["bad", "items"], "bad boolean, rule int", count).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("hits"))
    base, out = n_bad / n, []
    for r in seen.orderBy("rule").collect():  # one row a rule
        if r["n"] >= least_rows and r["hits"] >= min_confidence * r["n"] and lower_limit(r["hits"], r["n"], limit) > base:
            out.append((kept[r["rule"]][0], r["hits"] / r["n"]))
    return out


def inverted(rules: list[tuple[list[str], float]]) -> dict[str, list[tuple[frozenset, int]]]:
    """Rarest token of each rule -> the rules' token sets and numbers."""
    often = Counter(t for s, _ in rules for t in s)
    index: dict[str, list[tuple[frozenset, int]]] = {}
    for k, (s, _) in enumerate(rules):
        index.setdefault(min(s, key=lambda t: (often[t], t)), []).append((frozenset(s), k))
    return index


def given_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; rules: host -> [(path, verdict)]."""
    best, at = None, host
    while at:
        for prefix, verdict in rules.get(at, ()):
            if path.startswith(prefix) and (best is None or len(at) + len(prefix) > len(best[0])):
                best = (at + prefix, verdict)
        at = at.partition(".")[2]
    return best


def judge(pages: DataFrame, given: list[tuple[str, str, str]], mined: list[tuple[list[str], float]], key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict of every URL. given: (verdict, host, path)."""
    if len(given) > MOST_GIVEN:
        raise ValueError("too many rules to broadcast")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, p in given:
        by_host.setdefault(h, []).append((p, verdict))
    held = pages.sparkSession.sparkContext.broadcast((by_host, inverted(mined)))
    host, path = host_and_path(F.col("url"))

    def each(batch) -> dict:
        rules, index = held.value
        out: dict[str, list] = {"rule": [], "verdict": []}
        for u, h, p in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            fit = given_rule(h, p, rules)
            if fit is None:
                fit = (None, BLOCK if matching(set(tokens(h, p, u)), index) else ALLOW)
            out["rule"].append(fit[0])
            out["verdict"].append(fit[1])
        return {key: batch.column(0), "host": batch.column(2), "path": batch.column(3)} | out

    rows = pages.select(key, "url", host.alias("host"), path.alias("path"))
    return arrow_rows(rows, [key, "url", "host", "path"], f"{key} long, host string, path string, rule string, verdict string", each)
