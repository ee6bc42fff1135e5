import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.config import CheckpointPolicy, RunSettings
from codeloom.functions import providers as pv
from codeloom.plans import loop, restructure as rs
from codeloom.plans.analyse import analyse
from codeloom.sources import readers, sinks
from codeloom.sources.store import Conflict, Store
from codeloom.streaming import growth as sg


def test_corpus_json_round_trip(spark, tmp_path):
    made = {"responses": [{"id": 2, "question": "q", "content": "b", "source": "s", "meta": {"k": "v"}}, {"id": 1, "question": "q", "content": "a", "source": "s", "meta": {}}]}
    (tmp_path / "State-sample 20.json").write_text(json.dumps(made))
    (tmp_path / "bare.json").write_text(json.dumps(made["responses"]))
    for name in ("State-sample 20.json", "bare.json"):
        df = readers.load_corpus(spark, str(tmp_path / name))
        assert [(r["response_id"], r["content"], r["source"]) for r in readers.ordered(df).collect()] == [(1, "a", "s"), (2, "b", "s")]
    assert json.loads(sinks.corpus_json(df))["responses"][0]["id"] == 1 and readers.source_from_path("/x/State-sample 20.json") == "state-sample"
    sinks.write_corpus_json(df, str(tmp_path / "out.json"))
    assert readers.read_corpus_json(spark, str(tmp_path / "out.json")).count() == 2 and len(sinks.corpus_hash(df)) == 16
    assert readers.sniff(spark, str(tmp_path / "bare.json")) == "corpus"


def test_numbered_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿All,,Trimmed\n\"1. one, two\",,\"one, two\"\n2) two,,other\n1. again,,again\n,,\n", encoding="utf-8")
    rows, differ = readers.read_numbered_csv(spark, str(tmp_path / "n.csv"))
    assert sorted((r["response_id"], r["content"]) for r in rows.collect()) == [(1, "one, two"), (2, "two"), (1001, "again")]
    assert [r["number"] for r in differ.collect()] == [2]
    df, report = readers.load_corpus_with_report(spark, str(tmp_path / "n.csv"))
    assert report == {"responses": 3, "distinct_ids": 3, "empty": 0, "renumbered": 1}


def test_tables_and_definitions(spark, tmp_path):
    (tmp_path / "coded.csv").write_text("No,Response,Code\n1,a segment,fam-x\n2,other,fam-y\n,,\n")
    assert sorted(map(tuple, readers.read_coded_table(spark, str(tmp_path / "coded.csv")).collect())) == [(1, "a segment", "fam-x"), (2, "other", "fam-y")]
    (tmp_path / "pairs.csv").write_text("tag,content\nfam-x,words\n,\nfam-y,\n")
    assert readers.read_tagged_pairs(spark, str(tmp_path / "pairs.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("tag,content\n,words\n")
    with pytest.raises(ValueError):
        readers.read_tagged_pairs(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        readers.require(["a"], ("b",))
    (tmp_path / "book.md").write_text("## 1. Intro\n- **no**: not this\n## 3. Descriptions\n- **fam** (n=4): A family.\n- **fam-x** (n=3): A leaf.\ntext\n## 4. End\n- **later**: no\n")
    got = {r["name"]: (r["description"], r["count"]) for r in readers.read_definitions_md(spark, str(tmp_path / "book.md")).collect()}
    assert got == {"fam": ("A family.", 4), "fam-x": ("A leaf.", 3)}
    with pytest.raises(RuntimeError):
        readers.read_workbook(spark, str(tmp_path / "x.xlsx"))


def test_codebook_files_and_figures(spark, tmp_path):
    book = [{"id": "1", "name": "fam", "description": "d", "parent_id": None, "evidence": [{"response_id": 3, "quote": "q", "span": [0, 1], "verified": True, "score": 1.0}]}, {"id": "2", "name": "fam-x", "description": "", "parent_id": "1", "evidence": []}]
    (tmp_path / "b.json").write_text(json.dumps({"codes": book}))
    codes, proof = readers.read_codebook_json(spark, str(tmp_path / "b.json"))
    assert codes.count() == 2 and proof.first()["start"] == 0
    text = sinks.codebook_json(codes, proof)
    assert text == sinks.codebook_json(codes.orderBy(F.desc("name")), proof) and sinks.snapshot_id(text).startswith("snap-")
    assert "c0 --> c1" in sinks.mermaid(codes)
    assert sinks.curve_svg([(1, 3), (2, 0)], "t").startswith("<svg") and sinks.dendrogram_svg([(0, 1, 1.0, 2), (2, 3, 2.0, 3)], 3, "t").count("<path") == 2
    page = sinks.views_html({"codes": [{"name": "fam", "n": 1}]})
    assert "<td>fam</td>" in page and "quote" not in page and "&lt;" in sinks.codebook_html([{"name": "<x>", "quotes": ["q"]}])
    assert sinks.run_report({"b": 1, "a": 2}).splitlines()[2:] == ["a: 2", "b: 1"] and sinks.decision_matrix_markdown([{"rule": "a|b"}]).endswith("a\\|b |")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "s", "x"), (2, "s", "y"), (1, "s", "x")], "response_id long, source string, content string")
    assert store.append("responses", rows) == 2 and store.append("responses", rows) == 0 and store.read("responses").count() == 2
    assert store.write_snapshot("snap-1", "{}") and not store.write_snapshot("snap-1", "{}")
    with pytest.raises(Conflict):
        store.write_snapshot("snap-1", "{ }")
    store.emit("r", [("run_started", "", "", None, "{}"), ("run_ended", "", "", None, "{}")])
    store.emit("r", [("again", "", "", None, "{}")])
    assert sorted(r["event_id"] for r in store.read("audit").collect()) == [1, 2, 3]
    assert store.findings_summary("r").count() == 0


TABLE = {"time-saving": ("time", "hours", "faster"), "work-load": ("work", "load", "tasks"), "trust-data": ("privacy", "data", "trust")}


def responses(spark):
    made = ["It saves time. The work gets faster every day.", "I worry about my data and about trust in it.", "More tasks and more load for us. No time at all.", "I worry about my data and about trust in it.", "Nothing here fits the list of words."]
    return spark.createDataFrame(list(enumerate(made * 3, 1)), "response_id long, content string")


def test_fast_loop(spark):
    settings = RunSettings(batch_size=2, checkpoints=CheckpointPolicy(hard_floor_responses=3))
    state, rates = loop.run(responses(spark), TABLE, settings)
    assert set(state.names) >= {"time-saving", "work-load", "trust-data"} and len(set(state.names)) == len(state.names)
    # four different texts, two batches: the floor of three is reached in the second
    assert [h["batch"] for h in state.handovers] == [1, 2] and [h["trigger"] for h in state.handovers] == ["none", "floor"]
    assert all(0 <= r["rate"] <= 1 for r in rates.collect()) and {a[2] for a in state.assignments} <= set(state.names)
    again, _ = loop.run(responses(spark).repartition(3), TABLE, settings)
    assert again.names == state.names and again.assignments == state.assignments
    curve, _ = loop.run_curve(state, responses(spark).where("response_id in (1, 2, 3, 5)"), settings)
    assert curve.agg(F.sum("new_codes")).first()[0] == len(state.names)
    assert loop.first_trigger(health=False, spike=True, floor=True, cadence=False) == "spike"


def book():
    b = {}
    for name, parent, proof in [("fam", None, []), ("fam-a", "fam", [(1, "x"), (2, "y")]), ("fam-b", "fam", [(3, "z")]), ("other", None, [(4, "w")])]:
        c = rs.new_code(name, "d", rs.code_id(parent) if parent else None, proof)
        b[c["id"]] = c
    return b


def names(b):
    return sorted(c["name"] for c in b.values())


def test_operations():
    op = lambda kind, *targets, **payload: {"type": kind, "targets": list(targets), "payload": payload}
    after, effects = rs.apply_operations(book(), [op("merge", "fam-a", "fam-b", into="fam-ab")])
    assert names(after) == ["fam", "fam-ab", "other"] and effects[0]["removed"] == ["fam-a", "fam-b"]
    assert rs.evidence_of(after) == rs.evidence_of(book())
    after, _ = rs.apply_operations(book(), [op("split", "fam-a", into=[{"name": "fam-p", "response_ids": [2]}, {"name": "fam-q", "quotes": ["x"]}])])
    assert {c["name"]: c["evidence"] for c in after.values()}["fam-q"] == [(1, "x")]
    after, _ = rs.apply_operations(book(), [op("rename", "fam", name="new")])
    assert names(after) == ["new", "new-a", "new-b", "other"] and all(c["parent_id"] in (None, rs.code_id("new")) for c in after.values())
    after, _ = rs.apply_operations(book(), [op("reparent", "fam-a", parent=None), op("create", name="fam-c", parent_id=rs.code_id("fam"))])
    assert next(c for c in after.values() if c["name"] == "fam-a")["parent_id"] is None and "fam-c" in names(after)
    for bad in (op("create", name="fam"), op("merge", "fam-a"), op("reparent", "fam", parent="fam-a"), op("nonsense"), op("rename", "gone", name="x"), op("split", "fam-a", into=[{"name": "p"}])):
        assert rs.validate_script([bad], book())
    assert any("deep" in p for p in rs.validate_script([op("create", name="fam-a-x", parent_id=rs.code_id("fam-a"))], book()))


def test_checkpoint_gate():
    ops = [{"type": "create", "targets": [], "payload": {"name": "n1"}}, {"type": "create", "targets": [], "payload": {"name": "n2"}}]
    assert rs.run_checkpoint(book(), ops)["status"] == "rejected"
    done = rs.run_checkpoint(book(), ops, rs.scripted([False, True]))
    assert done["status"] == "applied" and "n2" in names(done["book"]) and "n1" not in names(done["book"])
    asked = rs.run_checkpoint(book(), ops, rs.console(lambda q: "y" if "n1" in q else ""))
    assert "n1" in names(asked["book"]) and rs.run_checkpoint(book(), [{"type": "x"}])["status"] == "invalid"


class Flaky:
    def complete_json(self, task, subject, payload):
        if subject == "bad":
            raise RuntimeError
        return {"echo": payload["v"]}


def test_providers(spark):
    req = spark.createDataFrame([("k1", "s", '{"v": 1}'), ("k2", "bad", '{"v": 2}'), ("k3", "s", '{"v": 3}'), ("k3", "s", '{"v": 3}')], "key string, subject string, payload string")
    cache = spark.createDataFrame([("k1", '{"echo": 9}')], "key string, reply string")
    got = {r["key"]: (r["reply"], r["cached"]) for r in pv.call_cached(req, cache, Flaky, "judge").collect()}
    assert got == {"k1": ('{"echo": 9}', True), "k2": ('{"verdict": "KEEP"}', False), "k3": ('{"echo": 3}', False)}
    waits = []
    calls = iter([ValueError(), 5])
    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x
    assert pv.retry(call, sleep=waits.append) == (5, 2) and 0.25 <= waits[0] < 0.75
    assert pv.parse_object('```json\n{"a": 1}\n```') == {"a": 1}
    assert pv.parse_candidates({"codes": [{"name": " n ", "evidence": {"1": "q"}}, {"no": 1}, "x"]}, 7)[0]["quotes"] == ["q"]
    assert pv.parse_operations({"operations": [{"type": "merge", "targets": [1]}, {"type": "drop"}]}) == [{"type": "merge", "targets": ["1"], "payload": {}, "rationale": ""}]
    assert pv.cache_key("t", "m", "v", {"b": 1, "a": 2}) == pv.cache_key("t", "m", "v", {"a": 2, "b": 1}) and pv.space_id("lexical", "v1", 512) in pv.EMBEDDERS
    e = pv.embed(spark.createDataFrame([(1, "time"), (2, "time"), (3, None)], "id long, text string"), "text")
    assert e.count() == 3 and len(e.first()["vector"]) == 512
    assert pv.define("a-b", ["time saves time"]).startswith("Covers a b: time")
    log = pv.CallLog({"m": (2.0, 8.0)})
    log.add("judge", "m", 1_000_000, 500_000)
    from codeloom.operators.eventlog import call_totals
    assert call_totals(log.frame(spark)).first()["cost_usd"] == 6.0


def test_analyse(spark):
    people = spark.createDataFrame([(k,) for k in range(1, 6)], "response_id long")
    coded = spark.createDataFrame([(1, "s", "a-x"), (2, "s", "a-x"), (2, "s", "b-y")], "response_id long, segment string, code string")
    got = analyse(people, coded)
    assert got["frequencies"].count() == 2 and got["filtered"].select("code").distinct().count() == 1
    with pytest.raises(ValueError):
        analyse(people.where("response_id > 1"), coded)


def test_streaming_growth_equals_batch(spark, tmp_path):
    where = tmp_path / "in"
    for k, codes in enumerate([["a", "b"], ["a", "c"], ["c"], ["d", "e", "f", "g", "h"]]):
        spark.createDataFrame([(k, c) for c in codes], "response_id long, code string").coalesce(1).write.mode("append").parquet(str(where))
    q = sg.start(sg.read_assignments(spark, str(where)), str(tmp_path / "store"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = [r["new_codes"] for r in sg.curve(spark, str(tmp_path / "store")).orderBy("batch").collect()]
    assert got == [2, 1, 0, 5] and [r["batch"] for r in sg.spikes_so_far(spark, str(tmp_path / "store")).collect()] == [4]
    s = sg.first_seen(sg.read_assignments(spark, str(where), 10)).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("seen").count() == 8


def test_loop_without_quotes_admits_the_same_codes(spark):
    texts_ = ["We use the tools every day. They save us time.", "The tools are slow! Nobody likes them.", "Time is money, they say.", None, "Mentions of tool use."]
    r = spark.createDataFrame(list(enumerate(texts_)), "response_id long, content string")
    table = {"tool-use": ("tools", "tool"), "time-saved": ("time",)}
    (whole, _), (bare, _) = (loop.run(r, table, quotes=q) for q in (True, False))
    assert bare.created == whole.created and whole.created and bare.findings == whole.findings
    assert whole.assignments and not bare.assignments
    plan = pv.code_responses(r, [pv.KeywordCoder(table, "A")], 0.85).collect()
    assert plan and all(c["proved"] and len(c["marks"]) == len(c["quotes"]) for c in plan)


def test_loop_does_not_grow_on_the_driver_with_the_corpus(spark, monkeypatch):
    seen, compared = [], []
    integrate, near = loop.integrate, loop.near_duplicate_pairs
    monkeypatch.setattr(loop, "integrate", lambda accepted, *rest: (seen.extend(accepted), integrate(accepted, *rest))[1])
    monkeypatch.setattr(loop, "near_duplicate_pairs", lambda state, tau: (compared.append(len(state.names)), near(state, tau))[1])
    r = spark.createDataFrame([(k, f"It saves time, case {k}. The work gets faster; trust the data of day {k}.") for k in range(1, 201)], "response_id long, content string")
    state, rates = loop.run(r, TABLE, RunSettings(batch_size=2), quotes=False)
    assert len(state.handovers) == 100 and sum(h["new_codes"] for h in state.handovers) == len(state.names)
    assert 0 < len(seen) == len(state.created) < 10 and len(compared) == len(set(compared)) <= len(state.names)
    assert rates.count() == 200


def test_openings_are_those_of_all_candidates_in_order(spark):
    rng, settings = random.Random(3), RunSettings()
    words = ["time", "save", "work", "load", "trust", "data"]
    kinds = sorted({("-".join(rng.sample(words, 2)), f"Mentions of {' '.join(rng.sample(words, 2))}.") for _ in range(40)})
    later = 0
    for trial in range(4):
        rows = sorted((k // 4 + 1, k, *kind) for k in range(60) for kind in rng.sample(kinds, 2))
        want, got = loop.RunState(), loop.RunState()
        for batch, i, name, description in rows:
            loop.integrate([{"response_id": i, "name": name, "description": description, "quotes": []}], want, settings)
        df = spark.createDataFrame(rows, "batch long, response_id long, name string, description string").repartition(3)
        first = {}
        for _, i, name, description in rows:
            first.setdefault((name, description), i)
        for c in loop.openings(df, got, settings):
            assert c["batch"] == c["response_id"] // 4 + 1
            later += c["response_id"] > first[c["name"], c["description"]]
            loop.integrate([c], got, settings)
        assert got.created == want.created and got.names == want.names and len(want.names) > 5
    assert later  # some were merged when they first came, and made codes after the codebook had changed


def test_loop_with_more_kinds_than_the_driver_looks_through(spark, monkeypatch):
    few, _ = loop.run(responses(spark), TABLE, quotes=False)
    monkeypatch.setattr(loop, "MOST_KINDS", 1)
    many, _ = loop.run(responses(spark), TABLE, quotes=False)
    assert many.created == few.created and many.handovers == few.handovers and few.created
