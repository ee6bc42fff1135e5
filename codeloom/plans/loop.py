"""The fast loop: a corpus in batches, coded, checked, matched and integrated; a handover reading after each batch.

What is per response (coding, checks, matching) is done where the response is read, in one pass; integration is a fold, because
a candidate is routed against a codebook that the one before it may have changed. The fold runs on the driver, one accepted
candidate after the other, and its state is the codebook. Where no assignments are asked for, only those candidates come to the
driver that change the codebook: what becomes of the others follows from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import RunSettings
from codeloom.functions.providers import DigestJudge, KeywordCoder, code_response, proved
from codeloom.operators import checks, segments
from codeloom.operators.growth import batches, growth, spikes
from codeloom.operators.similarity import lexical_cached, pair_up
from codeloom.runtime import ship

TRIGGERS = ("health", "spike", "floor", "cadence")
#: Kinds of candidates (name, description) that the driver looks through; beyond that it reads all candidates in order.
MOST_KINDS = 1000


def first_trigger(**fired: bool) -> str:
    return next((t for t in TRIGGERS if fired.get(t)), "none")


@dataclass
class RunState:
    names: list[str] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)
    created: list[tuple[int, str]] = field(default_factory=list)
    assignments: list[tuple[int, str, str]] = field(default_factory=list)
    handovers: list[dict] = field(default_factory=list)
    findings: int = 0
    paired: tuple[int, int] = (0, 0)


def code_text(name: str, description: str | None) -> str:
    """names.code_text of one code."""
    return f"{name}: {description}" if description else name


def route_one(name: str, vector: np.ndarray, state: RunState, settings: RunSettings) -> tuple[str, str]:
    """Where a candidate goes: a code of the working codebook, or a new one. An existing name is always a merge."""
    if name in state.names:
        return "MERGE", name
    if not state.names:
        return "CREATE", name
    scores = np.round(np.array(state.vectors) @ vector, 6)
    best = min(range(len(scores)), key=lambda k: (-scores[k], state.names[k]))
    if scores[best] >= settings.rules.tau_high:
        return "MERGE", state.names[best]
    if scores[best] < settings.rules.tau_low:
        return "CREATE", name
    verdict = DigestJudge("CREATE", "MERGE", 50).verdict(f"route:{name}:{state.names[best]}")
    return verdict, state.names[best] if verdict == "MERGE" else name


def integrate(accepted: list[dict], state: RunState, settings: RunSettings) -> None:
    for c in accepted:
        v = lexical_cached(code_text(c["name"], c["description"]))
        verdict, name = route_one(c["name"], v, state, settings)
        if verdict == "CREATE":
            state.names.append(name)
            state.vectors.append(v)
            state.created.append((c["response_id"], name))
        state.assignments += [(c["response_id"], q, name) for q in c["quotes"]]


def near_duplicate_pairs(state: RunState, tau_high: float) -> int:
    if len(state.names) < 2:
        return 0
    s = np.array(state.vectors) @ np.array(state.vectors).T
    family = [n.split("-", 1)[0] for n in state.names]
    return sum(s[i, j] >= tau_high and family[i] == family[j] for i in range(len(family)) for j in range(i))


def evaluate_handover(state: RunState, settings: RunSettings, batch: int, coded: int, since: int, new_codes: int, spiked: bool) -> dict:
    """Which triggers fire at a batch boundary, which are held, and the verdict."""
    p = settings.checkpoints
    if state.paired[0] != len(state.names):
        state.paired = (len(state.names), near_duplicate_pairs(state, settings.rules.tau_high))
    near = state.paired[1]
    event, spacing = p.mode == "event_driven", since >= p.min_responses_between_checkpoints
    health = near > p.max_near_duplicate_pairs or new_codes > p.max_new_codes_per_batch
    fired = {"health": event and spacing and health, "spike": event and spacing and spiked, "floor": since >= p.hard_floor_responses, "cadence": p.mode == "fixed" and coded in p.fixed_cadence}
    held = [t for t, raw in (("health", health), ("spike", spiked)) if raw and not fired[t]]
    trigger = first_trigger(**fired)
    return {"batch": batch, "responses_coded": coded, "since": since, "new_codes": new_codes, "near_duplicate_pairs": near, "fired": [t for t in TRIGGERS if fired[t]], "held": held, "trigger": trigger, "due": trigger != "none"}


@lru_cache(10_000)
def _matched(a: tuple[tuple[str, str], ...], b: tuple[tuple[str, str], ...], tau_high: float, tau_low: float) -> tuple[list[tuple[int | None, int | None]], float]:
    """What is kept of two coders' codes (name, description) for a response, as places in both (an agreed pair) or in one, and the
    rate of agreement. Responses with the same codes are matched once."""
    found = pair_up([lexical_cached(code_text(*c)) for c in a], [lexical_cached(code_text(*c)) for c in b], tau_high, tau_low, dissolve=False)
    rule, kept = DigestJudge("KEEP", "DROP", 80), [(i, j) for i, j, _, band in found if band == "agreed"]
    apart = [(a[i][0], (i, None)) for i, _, _, band in found if band != "agreed" and i is not None] + [(b[j][0], (None, j)) for _, j, _, band in found if band != "agreed" and j is not None]
    kept += [places for name, places in apart if rule.verdict(f"dispute:{name}") == "KEEP"]
    return kept, sum(band == "agreed" for *_, band in found) / max(len(a), len(b), 1)


def accept(a: list[dict], b: list[dict], settings: RunSettings) -> tuple[list[dict], float]:
    """Candidates of both coders for one response that hold, and the M1 rate of agreement: agreed ones once, with the evidence
    of both; grey and disputed ones and those of one coder unless a judge drops them."""
    a, b = (sorted(side, key=lambda c: c["name"]) for side in (a, b))
    kept, rate = _matched(*(tuple((c["name"], c["description"]) for c in side) for side in (a, b)), settings.rules.tau_high, settings.rules.tau_low)
    out = []
    for i, j in kept:
        own = [side[k] for side, k in ((a, i), (b, j)) if k is not None]
        quotes = own[0]["quotes"] if len(own) == 1 else sorted({q for c in own for q in c["quotes"]})
        out.append({"name": own[0]["name"], "description": next((c["description"] for c in own if c["description"] is not None), None), "quotes": quotes})
    return out, rate


CODED = "response_id {}, batch bigint, findings bigint, rate double, accepted array<struct<name:string,description:string,quotes:array<string>>>"


def coded(fresh: DataFrame, coders: list[KeywordCoder], settings: RunSettings, quotes: bool) -> DataFrame:
    """(response_id, batch, findings, rate, accepted) of responses (response_id, batch, content): coded, checked (S1, and a quote in
    the response) and matched. The rate is null where no candidate holds its evidence."""
    ship(fresh.sparkSession)

    def one(i: int, text: str | None) -> tuple[int, float | None, list[dict]]:
        found, body = code_response(i, text, coders)
        marked = [(c, checks.s1_markers(c["name"], c["description"], c["quotes"])) for c in found]
        whole = [c for c, m in marked if not {"missing_name", "missing_evidence"} & {*m} and proved(c, body, settings.rules.fuzzy_threshold)]
        kept, rate = accept([c for c in whole if c["coder"] == "A"], [c for c in whole if c["coder"] == "B"], settings)
        return sum(len(m) for _, m in marked), rate if whole else None, kept if quotes else [c | {"quotes": []} for c in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(i, t) for i, t in zip(b["response_id"], b["content"])]
            findings, rates, accepted = ([m[k] for m in made] for k in range(3))
            yield pd.DataFrame({"response_id": b["response_id"], "batch": b["batch"], "findings": findings, "rate": pd.Series(rates, dtype="float64"), "accepted": pd.Series(accepted, dtype=object)})

    return fresh.select("response_id", "batch", "content").mapInPandas(run, CODED.format(fresh.schema["response_id"].dataType.simpleString()))


def openings(accepted: DataFrame, state: RunState, settings: RunSettings) -> Iterator[dict]:
    """The accepted candidates (batch, response_id, name, description) that are to be made codes, in order; each has to be integrated
    before the next is asked for.

    Where a candidate goes is told by its name, its description and the codebook. So while the codebook stays, all of a kind go
    where the first goes, and the next to change it is the first candidate of those kinds that would be made a code now."""
    ahead = {(r["name"], r["description"]): r["first"] for r in accepted.groupBy("name", "description").agg(F.min(F.struct("response_id", "batch")).alias("first")).collect()}
    last = None
    while True:
        ready = []
        for (name, description), first in list(ahead.items()):
            if name in state.names:
                del ahead[name, description]
            elif route_one(name, lexical_cached(code_text(name, description)), state, settings)[0] == "CREATE":
                if last is not None and (first["response_id"], name) < last[:2]:
                    # merged so far: its next one after the change decides
                    later = (F.col("response_id") > last[0]) if name < last[1] else (F.col("response_id") >= last[0])
                    own = accepted.where((F.col("name") == name) & F.col("description").eqNullSafe(F.lit(description)) & later)
                    first = own.agg(F.min(F.struct("response_id", "batch")).alias("first")).first()["first"]
                    if first is None:
                        del ahead[name, description]
                        continue
                    ahead[name, description] = first
                ready.append(((first["response_id"], name, description or ""), description, first["batch"]))
        if not ready:
            return
        last, description, batch = min(ready, key=lambda x: x[0])
        yield {"response_id": last[0], "batch": batch, "name": last[1], "description": description, "quotes": []}


def run(responses: DataFrame, table: dict[str, tuple[str, ...]], settings: RunSettings = RunSettings(), halt: bool = False, quotes: bool = True) -> tuple[RunState, DataFrame]:
    """Code a corpus (response_id, content) batch by batch; returns the state and the M1 agreement rates per response. Quotes are
    looked up in their response when it is coded. Without `quotes` they go no further than that, and the state has no assignments;
    codes are admitted all the same."""
    spark = responses.sparkSession
    stays = lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
    coders = [KeywordCoder(table, "A"), KeywordCoder(table, "B", fallback="other-misc")]
    first = stays(segments.firsts(responses))
    # a table by hash: the ids are small beside the texts, which then need no sorting
    fresh = responses.select("response_id", "content").join(batches(first, settings.batch_size).hint("shuffle_hash"), "response_id")
    done = stays(coded(fresh, coders, settings, quotes))
    rates = done.where("rate is not null").select("response_id", "rate")
    accepted = done.select("response_id", "batch", F.explode("accepted").alias("c")).select("response_id", "batch", "c.*")
    state, so_far, since = RunState(findings=done.agg(F.sum("findings")).first()[0] or 0), 0, 0
    if quotes or accepted.select("name", "description").distinct().limit(MOST_KINDS + 1).count() > MOST_KINDS:
        rows = (r.asDict() for r in accepted.orderBy("batch", "response_id", "name", "description").toLocalIterator())
    else:
        rows = openings(accepted, state, settings)
    n = first.count()
    held = next(rows, None)
    for batch in range(1, -(-n // settings.batch_size) + 1):
        before = len(state.names)
        while held is not None and held["batch"] == batch:
            integrate([held], state, settings)
            held = next(rows, None)
        size = min(settings.batch_size, n - so_far)
        so_far, since = so_far + size, since + size
        counts = [h["new_codes"] for h in state.handovers[-settings.checkpoints.spike_window :]]
        new = len(state.names) - before
        p = settings.checkpoints
        spiked = len(counts) >= p.spike_window and new >= p.spike_min_new_codes and new >= p.spike_factor * float(np.median(counts))
        told = evaluate_handover(state, settings, batch, so_far, since, new, spiked)
        state.handovers.append(told)
        if told["due"]:
            since = 0
            if halt:
                break
    return state, rates


def run_curve(state: RunState, responses: DataFrame, settings: RunSettings = RunSettings()) -> tuple[DataFrame, DataFrame]:
    """Growth and spikes of a run's admissions."""
    spark = responses.sparkSession
    rows = spark.createDataFrame(state.created, "response_id bigint, code string")
    curve = growth(rows, batches(responses, settings.batch_size))
    return curve, spikes(curve, settings.checkpoints.spike_factor, settings.checkpoints.spike_window, settings.checkpoints.spike_min_new_codes)
