"""Model roles as Arrow functions: embedders, coders, judges, definers, their cache and their deterministic stand-ins.

A client is made once per Python worker from a picklable factory; replies are cached in a Parquet table by content key, and an
anti-join keeps a known request from being sent again. Live providers are interfaces only: there is no network here.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import kernels
from codeloom.runtime import ship


class Client(Protocol):
    def complete_json(self, task: str, subject: str, payload: dict) -> dict: ...


class Embedder(Protocol):
    space_id: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class LexicalEmbedder:
    dims: int = kernels.DIMS

    @property
    def space_id(self) -> str:
        return space_id("lexical", "v1", self.dims)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [kernels.lexical_vector(t, self.dims).tolist() for t in texts]


def space_id(mode: str, model: str, dims: int, label: str = "") -> str:
    core = f"{mode}-{model}-{dims}"
    return f"{label}+{core}" if label and label != core else core


#: Space id -> embedder; others are added by register().
EMBEDDERS: dict[str, Embedder] = {e.space_id: e for e in (LexicalEmbedder(),)}


def register(embedder: Embedder) -> None:
    EMBEDDERS[embedder.space_id] = embedder


def embed(texts: DataFrame, column: str, space: str = "lexical-v1-512") -> DataFrame:
    """texts with a column `vector`; every distinct text is embedded once and joined back."""
    spark, e = texts.sparkSession, EMBEDDERS[space]
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__text": b["__text"], "vector": e.embed(b["__text"].tolist()) if len(b) else []})

    distinct = texts.select(F.coalesce(column, F.lit("")).alias("__text")).distinct()
    made = distinct.mapInPandas(run, "__text string, vector array<double>")
    return texts.withColumn("__text", F.coalesce(column, F.lit(""))).join(made, "__text").drop("__text")


# replies that change nothing, per task
FAIL_SAFE: dict[str, dict] = {"coder": {"codes": []}, "judge": {"verdict": "KEEP"}, "refactorer": {"operations": []}, "definer": {"description": ""}}


def fail_safe(task: str) -> dict:
    return dict(FAIL_SAFE.get(task, {}))


def retry(call: Callable[[], Any], attempts: int = 3, base_s: float = 0.5, seed: int = 0, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, int]:
    """The result and the attempts it took; waits grow twofold with a seeded share of chance."""
    rng = random.Random(seed)
    for k in range(1, attempts + 1):
        try:
            return call(), k
        except Exception:
            if k == attempts:
                raise
            sleep(base_s * 2 ** (k - 1) * (0.5 + rng.random()))
    raise ValueError("attempts must be at least 1")


def cache_key(task: str, model: str, prompt_version: str, payload: dict) -> str:
    text = json.dumps([task, model, prompt_version, payload], sort_keys=True, ensure_ascii=False)
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def call_cached(requests: DataFrame, cache: DataFrame, client: Callable[[], Client], task: str) -> DataFrame:
    """(key, reply, cached) for requests (key, subject, payload JSON): known keys come from the cache (key, reply), the others
    are sent once each; a request that keeps failing gets the reply that changes nothing."""
    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for b in batches:
            replies = []
            for subject, payload in zip(b["subject"], b["payload"]):
                try:
                    reply, _ = retry(lambda s=subject, p=payload: c.complete_json(task, s, json.loads(p)), base_s=0.0)
                except Exception:
                    reply = fail_safe(task)
                replies.append(json.dumps(reply, sort_keys=True, ensure_ascii=False))
            yield pd.DataFrame({"key": b["key"], "reply": replies, "cached": False})

    distinct = requests.dropDuplicates(["key"])
    known = distinct.select("key").join(cache.select("key", "reply"), "key").withColumn("cached", F.lit(True))
    return known.unionByName(distinct.join(cache.select("key"), "key", "left_anti").select("key", "subject", "payload").mapInPandas(run, "key string, reply string, cached boolean"))


def parse_object(text: str) -> dict:
    """One JSON object, with or without a Markdown fence around it."""
    inside = re.sub(r"^```\w*\s*\n|\n?```$", "", text.strip())
    value = json.loads(inside)
    if not isinstance(value, dict):
        raise ValueError("the reply is no object")
    return value


def parse_candidates(reply: dict, response_id: int, coder: str = "") -> list[dict]:
    """Candidates of a reply under "codes"; entries that cannot be read are left out."""
    out = []
    for c in reply.get("codes", []) if isinstance(reply.get("codes"), list) else []:
        if isinstance(c, dict) and isinstance(c.get("name"), str):
            quotes = c.get("evidence", [])
            quotes = quotes.values() if isinstance(quotes, dict) else quotes
            found = [q.get("quote") if isinstance(q, dict) else q for q in quotes]
            out.append({"response_id": response_id, "coder": coder, "ordinal": len(out), "name": c["name"].strip(), "description": str(c.get("description") or ""), "quotes": [q for q in found if isinstance(q, str) and q.strip()]})
    return out


OPERATIONS = ("create", "merge", "split", "reparent", "rename")


def parse_operations(reply: dict) -> list[dict]:
    made = [o for o in reply.get("operations", []) if isinstance(o, dict) and o.get("type") in OPERATIONS]
    return [{"type": o["type"], "targets": [str(t) for t in o.get("targets", [])], "payload": o.get("payload") or {}, "rationale": str(o.get("rationale") or "")} for o in made]


def parse_description(reply: dict) -> str:
    d = reply.get("description")
    return kernels.normalise(d) if isinstance(d, str) else ""


def pieces(body: str) -> list[tuple[str, frozenset[str]]]:
    """The segments of a normalised text, each with its words."""
    return [(q, frozenset(kernels.WORD.findall(q.casefold()))) for a, b in kernels.segment_spans(body) for q in [body[a:b]]]


@dataclass(frozen=True)
class KeywordCoder:
    """A deterministic coder: a segment gets the codes whose keywords it holds, else the persona's fallback. The persona
    decides which of two names a code has where the table gives two."""

    table: dict[str, tuple[str, ...]]
    persona: str = "A"
    fallback: str = "other-general"
    most: int = 12

    def candidates(self, response_id: int, text: str) -> list[dict]:
        return self.of(response_id, pieces(kernels.normalise(text)))

    def of(self, response_id: int, parts: list[tuple[str, frozenset[str]]]) -> list[dict]:
        """Candidates from a response's pieces, which all coders share."""
        found, known = {}, [(n, frozenset(words)) for n, words in self.table.items()]
        for quote, tokens in parts:
            names = [n for n, words in known if not words.isdisjoint(tokens)] or [self.fallback]
            for n in names[:2]:
                found.setdefault(n, []).append(quote)
        return [{"response_id": response_id, "coder": self.persona, "ordinal": k, "name": n, "description": f"Mentions of {n.replace('-', ' ').replace('_', ' ')}.", "quotes": q} for k, (n, q) in enumerate(sorted(found.items())[: self.most])]


CANDIDATE = "response_id bigint, coder string, ordinal int, name string, description string, quotes array<string>"


def proved(candidate: dict, body: str, threshold: float) -> bool:
    """Whether one of a candidate's quotes is found in its response, whose text is normalised."""
    return any(q and kernels.normalise(q) and kernels.locate(q, body, threshold)[0] for q in candidate["quotes"])


def code_response(response_id: int, text: str | None, coders: list[KeywordCoder]) -> tuple[list[dict], str]:
    """Candidates of every coder for one response, and its normalised text."""
    body = kernels.normalise(text or "")
    parts = pieces(body)
    return [c for coder in coders for c in coder.of(response_id, parts)], body


def code_responses(responses: DataFrame, coders: list[KeywordCoder], threshold: float | None = None) -> DataFrame:
    """Candidates of every coder for responses (response_id, content). With a threshold, each also says whether one of its quotes
    is found in its response (proved), and has a mark per quote: the quote where the description copies it, else empty. So
    neither needs the texts again."""
    ship(responses.sparkSession)

    def judged(c: dict, body: str) -> dict:
        key = kernels.match_key(c["description"] or "")
        return c | {"proved": proved(c, body, threshold), "marks": [q if key and kernels.match_key(q) == key else "" for q in c["quotes"]]}

    more = [] if threshold is None else ["proved", "marks"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["response_id"], b["content"]):
                made, body = code_response(i, t, coders)
                rows += [judged(c, body) for c in made] if more else made
            yield pd.DataFrame(rows, columns=["response_id", "coder", "ordinal", "name", "description", "quotes", *more])

    return responses.select("response_id", "content").mapInPandas(run, CANDIDATE + (", proved boolean, marks array<string>" if more else ""))


@dataclass(frozen=True)
class DigestJudge:
    """A deterministic judge: a digest of the subject decides, with the given chance in a hundred of the first verdict."""

    first: str = "KEEP"
    second: str = "DROP"
    percent: int = 70

    def verdict(self, subject: str) -> str:
        return self.first if int(hashlib.sha256(subject.encode()).hexdigest()[:8], 16) % 100 < self.percent else self.second


def judge(rows: DataFrame, subject: str, ruling: DigestJudge) -> DataFrame:
    ship(rows.sparkSession)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: ruling.verdict(v or ""))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return rows.withColumn("verdict", F.pandas_udf(run, "string")(subject))


def define(name: str, segments: list[str], words: int = 12) -> str:
    """An extractive stand-in for a definer: the code's commonest words, no run of a segment."""
    counts: dict[str, int] = {}
    for s in segments:
        for t in kernels.lexical_tokens(s):
            counts[t] = counts.get(t, 0) + 1
    top = sorted(counts, key=lambda t: (-counts[t], t))[:words]
    return f"Covers {name.replace('-', ' ').replace('_', ' ')}: {', '.join(top)}." if top else ""


@dataclass
class CallLog:
    """Calls per task with tokens and cost."""

    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)

    def add(self, task: str, model: str, input_tokens: int, output_tokens: int) -> None:
        self.rows.append((task, input_tokens, output_tokens, *self.rates.get(model, (0.0, 0.0))))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "task string, input_tokens bigint, output_tokens bigint, input_rate double, output_rate double")
