import pytest

from codeloom.plans import timeline, validation as va


def test_concurrent_validation_and_calibration(spark):
    human = spark.createDataFrame([(1, "time planning"), (2, "time planning"), (2, "trust"), (3, "trust"), (4, "cost worry")], "response_id long, code string")
    machine = spark.createDataFrame([(1, "planning time", "we plan the time"), (2, "planning time", "time plans"), (3, "trust", "trust in it"), (4, "weather", "sunny day")], "response_id long, code string, segment string")
    got = va.concurrent_validation(human, machine)
    level = got["code_level"].first()
    assert (level["tp"], level["fp"], level["fn"]) == (3, 1, 2) and level["precision"] == 0.75 and level["recall"] == 0.6
    assert got["matched_only"].first()["fp"] == 0
    assert [r["code"] for r in got["over_coding"].collect()] == ["weather"] and [r["code"] for r in got["blind_spots"].collect()] == ["cost worry"]
    told = va.calibrate(human, machine)
    assert set(told) == {"tau_fit", "tau_high", "tau_low"} and told["tau_low"]["recommended"] <= told["tau_high"]["recommended"]


def test_crosswalk(spark):
    a = spark.createDataFrame([("fam-time", ""), ("fam-odd", ""), ("two-trust", "")], "name string, description string")
    b = spark.createDataFrame([("x-cost", ""), ("y-trust", ""), ("fam-time", "")], "name string, description string")
    got = va.crosswalk(a, b)
    assert {r["name"]: r["band"] for r in got["mapping"].collect()} == {"fam-time": "same", "fam-odd": "grey", "two-trust": "grey"}
    assert {(r["family"], r["other_family"]): r["n"] for r in got["rollup"].collect()} == {("fam", "fam"): 2, ("two", "y"): 1}
    matched, rate = va.compare_codebooks(a, b)
    assert rate == pytest.approx(1 / 3) and matched.count() == 3


def test_timeline(spark):
    log = [(1, "response_prepared", "11", "{}"), (2, "code_created", "c1", '{"response_id": 11}'), (3, "judge_consulted", "x", "{}"), (4, "checkpoint_evaluated", "", '{"batch": 1}'), (5, "response_prepared", "12", "{}"), (6, "code_merged", "c1", '{"response_id": 12}'), (7, "checkpoint_started", "", '{"n": 1}'), (8, "operation_applied", "", '{"renamed": {"c1": "c9"}}'), (9, "checkpoint_decided", "", '{"ok": true}')]
    events = spark.createDataFrame([("r", *e) for e in log], "run_id string, event_id long, event string, subject string, payload string")
    assert sorted((r["batch"], r["n_responses"], r["n_new_codes"], r["n_judge_calls"]) for r in timeline.batch_summary(events).collect()) == [(1, 1, 1, 1), (2, 1, 0, 0)]
    life = timeline.biographies(events).first()
    assert (life["born_response"], life["n_merged"], life["fate"], life["successor"]) == (11, 1, "renamed", "c9")
    assert timeline.checkpoints(events).first()["started_payload"] == '{"n": 1}'
    base = spark.createDataFrame([("c1", "old")], "code_id string, name string")
    from codeloom.operators.eventlog import renamed_ids
    assert timeline.lineage(base, renamed_ids(events)).first()["old_name"] == "old"
    occ = spark.createDataFrame([(5, "a"), (6, "a"), (6, "b")], "response_id long, code string")
    place = spark.createDataFrame([(6, 1), (5, 2)], "response_id long, place long")
    assert {r["code"]: r["response_id"] for r in timeline.first_appearance(occ, place).collect()} == {"a": 6, "b": 6}
