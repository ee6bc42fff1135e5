import pytest
from pyspark.sql import functions as F

from codeloom.config import CodingRules
from codeloom.functions import names, texts, udfs
from codeloom.operators import agreement, checks, clustering, codebook, eventlog, growth, lexical, occurrence, organise, segments, similarity, withheld


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def occ(spark):
    table = {1: ["a-x", "a-y", "b-z"], 2: ["a-x", "b-z"], 3: ["a-y"], 4: ["a-x", "a-y", "b-z"], 5: ["c"]}
    return spark.createDataFrame([(r, c) for r, cs in table.items() for c in cs] + [(1, "a-x")], "response_id long, code string")


def test_matrix_and_filter(spark, occ):
    o = occurrence.occurrence(occ)
    assert o.count() == 10
    universe = spark.createDataFrame([(k,) for k in range(1, 8)], "response_id long")
    m = occurrence.build_matrix(universe, occ)
    assert rows(m.where("code is null"), "response_id") == [(6,), (7,)]
    assert occurrence.unknown_responses(universe.where("response_id > 1"), occ).count() == 1
    got = {r["code"]: r for r in occurrence.frequency_filter(o, 2, 0.41).collect()}
    assert got["a-x"]["threshold"] == 3 and got["a-x"]["kept"] and got["c"]["reason"] == "absolute"
    wide = occurrence.dense(o, ["a-x", "a-y", "b-z", "c"]).orderBy("response_id").collect()
    assert [tuple(r)[1:] for r in wide] == [(1, 1, 1, 0), (1, 0, 1, 0), (0, 1, 0, 0), (1, 1, 1, 0), (0, 0, 0, 1)]


def test_fraction_threshold_needs_its_tolerance(spark):
    n = spark.range(1).select(occurrence.fraction_threshold(0.07, F.lit(100)).alias("t")).first()["t"]
    assert n == 7 and 0.07 * 100 > 7


def test_patterns(occ):
    o = occurrence.occurrence(occ)
    assert rows(occurrence.signature_groups(o), "signature", "size") == [("a|b", 3)]
    assert rows(occurrence.singletons(o), "response_id") == [(3,), (5,)]
    pairs = {(r["code_a"], r["code_b"]): r for r in occurrence.frequent_pairs(o, 2).collect()}
    assert pairs["a-x", "b-z"]["support"] == 3 and pairs["a-x", "b-z"]["lift"] == pytest.approx((3 / 5) / (3 / 5 * 3 / 5))
    triples = occurrence.frequent_triples(o, 2).collect()
    assert [(r["code_a"], r["code_b"], r["code_c"], r["support"]) for r in triples] == [("a-x", "a-y", "b-z", 2)]
    mates = rows(occurrence.nearest_mates(o, 1), "response_id", "mate", "jaccard")
    assert mates[0] == (1, 4, 1.0)
    c = {(r["code_a"], r["code_b"]): r["jaccard"] for r in occurrence.cooccurrence(o).collect()}
    assert c["a-x", "a-x"] == 1 and c["a-x", "a-y"] == pytest.approx(2 / 4)


def test_growth_and_saturation(spark, occ):
    universe = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7)], "response_id long")
    curve = growth.growth(occurrence.occurrence(occ), growth.batches(universe, 2))
    assert rows(curve, "batch", "responses_in_batch", "new_codes", "cumulative_codes") == [(1, 2, 3, 3), (2, 2, 0, 3), (3, 2, 1, 4), (4, 1, 0, 4)]
    assert growth.saturated_at(curve).first()[0] == 2


def test_places_over_several_buckets(spark):
    ids = [5, 3, 40, 41, 1000, 7]
    got = {r["response_id"]: r["place"] for r in growth.place(spark.createDataFrame([(i,) for i in ids], "response_id long"), bucket=10).collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(ids))}


def test_spikes(spark):
    series = [9, 1, 1, 4, 1, 0, 0, 0, 3, 0, 4]
    curve = spark.createDataFrame(list(enumerate(series, 1)), "batch long, new_codes long")
    got = [(r["batch"], r["baseline"], r["ratio"]) for r in growth.spikes(curve).orderBy("batch").collect()]
    assert got == [(4, 1.0, 4.0), (11, 0.0, None)]


def test_agreement_fixture(spark):
    both = [(r, "c1") for r in range(1, 5)] + [(5, "c2"), (6, "c3")]
    human = spark.createDataFrame(both + [(7, "c4"), (8, "c5")], "response_id long, code string")
    machine = spark.createDataFrame(both + [(7, "c6"), (8, "c4")], "response_id long, code string")
    got = agreement.scores(human, machine).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (6, 2, 2, 38)
    assert got["precision"] == got["recall"] == got["f1"] == 0.75 and got["kappa"] == 0.7
    assert rows(agreement.unmatched_codes(machine, human), "code") == [("c6",)]


def test_segment_agreement(spark):
    schema = "row_id long, response_id long, code string, start int, end int, segment string"
    human = spark.createDataFrame([(1, 1, "a", 0, 10, "x"), (2, 1, "b", 20, 30, "y"), (3, 2, "a", None, None, "some words")], schema)
    machine = spark.createDataFrame([(1, 1, "a", 0, 10, "x"), (2, 1, "b", 29, 40, "y"), (3, 2, "a", None, None, "some")], schema)
    got = {r["row_id"]: r["overlap"] for r in agreement.segment_overlaps(machine, human).collect()}
    assert got == {1: 1.0, 2: pytest.approx(1 / 20), 3: pytest.approx(0.4)}
    assert agreement.segment_agreement(human, machine).first()["right_code_wrong_place"] == 2


def test_sweep_and_recommendation(spark):
    units = spark.createDataFrame([(0.1, True), (0.2, True), (0.3, False), (0.6, False), (0.25, True)], "score double, label boolean")
    curve = sorted((r.asDict() for r in agreement.sweep(units, [0.0, 0.3, 0.7], predict_below=True).collect()), key=lambda r: r["threshold"])
    assert [(c["tp"], c["fp"], c["fn"], c["tn"]) for c in curve] == [(0, 0, 3, 2), (3, 0, 0, 2), (3, 2, 0, 0)]
    assert agreement.recommend(curve, 0.5)["recommended"] == 0.3 and not agreement.recommend(curve, 0.5)["single_class"]
    assert agreement.recommend([{"threshold": 0.1, "tp": 3, "fp": 0, "fn": 0, "tn": 0, "f1": 1.0}], 0.1)["single_class"]


def test_names_and_ids(spark):
    import hashlib

    df = spark.createDataFrame([("ai-super-x",), ("bare",), ("has space-x",), ("Upper-Ok",), ("bad-",)], "n string")
    got = {r["n"]: r for r in df.select("n", names.family_of("n").alias("f"), names.sub_of("n").alias("s"), names.grammar_reasons("n").alias("g"), names.code_id("n").alias("i")).collect()}
    assert (got["ai-super-x"]["f"], got["ai-super-x"]["s"]) == ("ai", "super-x") and got["bare"]["s"] == ""
    assert got["has space-x"]["g"] == ["whitespace", "part_pattern"] and got["Upper-Ok"]["g"] == [] and got["bad-"]["g"] == ["part_pattern"]
    assert got["bare"]["i"] == "code-" + hashlib.sha256(b"bare").hexdigest()[:16]
    mint = spark.range(1).select(names.mint("x", F.lit(None), F.lit(""), F.lit(True), F.lit(3))).first()[0]
    assert mint == "x-" + hashlib.sha256("\x00\x1f\x1ftrue\x1f3".encode()).hexdigest()[:16]


def test_text_expressions_equal_the_kernels(spark):
    from codeloom.functions import kernels

    samples = ["The jobs are running; studies of glasses!", "", "One. Two? Three...", "a b \x1cc"]
    df = spark.createDataFrame([(t,) for t in samples], "t string")
    for r in df.select("t", texts.lexical_tokens("t").alias("x"), texts.word_count("t").alias("w"), texts.squeeze("t").alias("s"), udfs.normalise(spark)("t").alias("n")).collect():
        assert r["x"] == kernels.lexical_tokens(r["t"]) and r["w"] == len(r["t"].split()) and r["n"] == kernels.normalise(r["t"])
        assert r["s"] == " ".join(r["t"].split())


def test_codebook_checks(spark):
    codes = spark.createDataFrame([("1", "fam", "d", None), ("2", "fam-a", "d", "1"), ("3", "FAM-A", "d", "1"), ("4", "lost-x", "d", "none"), ("5", "deep-y", "", "2"), ("6", "loop-p", "d", "7"), ("7", "loop-q", "d", "6"), ("8", "odd name-x", "d", "1")], "code_id string, name string, description string, parent_id string")
    proof = spark.createDataFrame([("1", 1, "q", True), ("5", 99, "q", True)], "code_id string, response_id long, quote string, verified boolean")
    found = codebook.check_codebook(codes, proof, spark.createDataFrame([(1,)], "response_id long"))
    got = rows(found.select("severity", "subject", F.get_json_object("data", "$.marker").alias("m")), "m", "subject")
    assert got == sorted([("duplicate_name", "FAM-A"), ("orphan_parent", "lost-x"), ("parent_cycle", "loop-p"), ("parent_cycle", "loop-q"), ("hierarchy_too_deep", "deep-y"), ("evidence_on_parent", "fam"), ("missing_description", "deep-y"), ("evidence_response_missing", "deep-y"), ("name_grammar", "odd name-x")])
    assert {r["code_id"]: r["depth"] for r in codebook.chains(codes).collect()}["5"] == 3
    assert codebook.gini(spark.createDataFrame([(1,), (1,), (4,)], "size long")).first()[0] == pytest.approx(round((2 * (1 + 2 + 12)) / (3 * 6) - 4 / 3, 6))


def test_candidate_checks(spark):
    c = spark.createDataFrame([(1, "A", 0, "fam-x", "said it"), (1, "A", 1, "", "d"), (1, "A", 2, "fam", ""), (1, "B", 0, "fam-x", "d")], "response_id long, coder string, ordinal int, name string, description string")
    e = spark.createDataFrame([(1, "A", 0, "Said  it"), (1, "A", 0, "the tool was usefull to us"), (1, "A", 1, "x"), (1, "A", 2, "never spoken at all here")], "response_id long, coder string, ordinal int, quote string")
    kept, found = checks.s1_schema(c, e)
    assert rows(kept, "coder", "ordinal") == [("A", 0), ("A", 2)]
    assert rows(found.select(F.get_json_object("data", "$.marker").alias("m")), "m") == [("description_copies_quote",), ("missing_description",), ("missing_evidence",), ("missing_name",)]
    r = spark.createDataFrame([(1, "People said it often, and the tool was useful to us.")], "response_id long, content string")
    placed = {x["quote"]: x for x in checks.s2_locate(e, r).collect()}
    assert placed["the tool was usefull to us"]["found"] and placed["the tool was usefull to us"]["score"] < 1 and not placed["never spoken at all here"]["found"]
    assert rows(checks.s2_findings(checks.s2_locate(e, r)), "severity") == [("ERROR",), ("ERROR",), ("INFO",), ("INFO",)]
    assert checks.s2b_bounds(spark.createDataFrame([("A. B. C.",), ("w " * 41,), ("fine",)], "quote string")).count() == 2
    assert rows(checks.s3_names(c.where("name <> ''"), spark.createDataFrame([("fam-z",)], "name string")).select(F.get_json_object("data", "$.marker").alias("m"), "subject"), "m", "subject") == [("bare_top_level", "fam")]
    low = rows(checks.s5_counts(c.where("name <> ''"), r, ["A", "B", "C"]), "coder", "n_codes")
    assert low == [("B", 1), ("C", 0)]
    spans = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 1, 10), (1, "c", 2, 11), (1, "d", 40, 50), (2, "a", 0, 5)], "response_id long, code string, start int, end int")
    assert rows(checks.s4_clusters(spans), "response_id", "n_codes") == [(1, 3)]


def test_description_guards(spark):
    seg = ["we plan the whole week together every single monday morning", "short"]
    d = spark.createDataFrame([("a", "", seg), ("b", "One. Two. Three. Four.", []), ("c", "SHORT", seg), ("d", "they plan the whole week together every single monday here", seg), ("e", "Covers planning.", seg)], "code string, description string, segments array<string>")
    assert rows(checks.describe_guards(d), "check_id", "subject") == [("D1", "a"), ("D2", "b"), ("D3", "c"), ("D4", "d")]


def test_labels(spark):
    counts = spark.createDataFrame([("Fam-a", 3), ("fam-a", 3), ("fam - a", 9), ("key-sectors", 1), ("key_sectors-x", 4), ("key_sectors-y", 2), ("other", 1)], "label string, count long")
    got = {r["label"]: (r["canonical"], r["rule"]) for r in organise.consolidate(counts).collect()}
    assert got["Fam-a"] == ("fam-a", "case") and got["fam - a"] == ("fam-a", "whitespace") and got["fam-a"] == ("fam-a", "")
    assert got["key-sectors"] == ("key_sectors", "family_separator") and got["key_sectors-x"] == ("key_sectors-x", "")
    miss = organise.near_misses(spark.createDataFrame([("colour",), ("color",), ("collar",), ("abc",), ("abd",)], "label string"))
    assert rows(miss, "label_a", "label_b", "distance") == [("collar", "color", 2), ("collar", "colour", 2), ("color", "colour", 1)]
    t = organise.tree(counts)
    assert rows(t.where("family = 'key_sectors'"), "place", "name", "family_count") == [(1, "key_sectors-x", 6), (2, "key_sectors-y", 6)]
    assert organise.to_codebook(t).count() == 12  # six families and six leaves


def test_event_log(spark):
    log = [(1, "response_prepared", "11", "{}"), (2, "judge_consulted", "x", "{}"), (3, "response_prepared", "12", "{}"), (4, "checkpoint_evaluated", "", '{"batch": 1}'), (5, "judge_consulted", "y", "{}"), (6, "response_prepared", "13", "{}"), (7, "code_created", "c1", '{"response_id": 13}')]
    events = spark.createDataFrame([("r", *e) for e in log], "run_id string, event_id long, event string, subject string, payload string")
    assert rows(eventlog.batch_of_response(events), "response_id", "batch") == [(11, 1), (12, 1), (13, 2)]
    assert rows(eventlog.judge_calls(events), "response_id", "n") == [(11, 1), (12, 1)]
    assert eventlog.since_marker(events, "response_prepared", "checkpoint_evaluated").first()["n"] == 1
    assert rows(eventlog.brackets(events, "response_prepared", "checkpoint_evaluated"), "event_id", "bracket")[-1] == (7, 3)
    assert growth.growth_from_audit(events, 2).where("batch = 2").first()["new_codes"] == 1


def test_matching(spark):
    vector = udfs.lexical_vector(spark)
    side = lambda names_: spark.createDataFrame([(1, n) for n in names_], "response_id long, name string").withColumn("vector", vector("name"))
    a, b = side(["planning time", "team trust", "odd"]), side(["time planning", "trust", "else"])
    got = {(r["name_a"], r["name_b"]): r["band"] for r in similarity.match(a, b, "response_id").collect()}
    assert got["planning time", "time planning"] == "agreed" and got["team trust", "trust"] == "grey" and got["odd", None] == "only_a"
    kept = similarity.match(a, b, "response_id", dissolve=False)
    assert rows(kept.where("name_a = 'odd'"), "band") == [("disputed",)]
    assert similarity.agreement_rate(kept, "response_id").first()["rate"] == pytest.approx(1 / 3)
    lone = similarity.match(a, b.where("name = 'none'"), "response_id")
    assert lone.count() == 3


def test_search_and_near_duplicates(spark):
    codes = spark.createDataFrame([(k, f"c{k % 3}-x{k}", [float(k), 1.0]) for k in range(1, 8)], "code_id long, name string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    whole, parts = (rows(similarity.top_k(q, codes, 2, block=b), "query_id", "rank", "code_id") for b in (100, 2))
    assert whole == parts == [(1, 1, 7), (1, 2, 6), (2, 1, 1), (2, 2, 2)]
    leaves = spark.createDataFrame([("a-x", [1.0, 0.0]), ("a-y", [1.0, 0.01]), ("b-x", [1.0, 0.0]), ("bare", [1.0, 0.02])], "name string, vector array<double>")
    assert rows(similarity.near_duplicate_leaves(leaves, 0.9), "name_a", "name_b") == [("a-x", "a-y"), ("a-x", "bare"), ("a-y", "bare"), ("b-x", "bare")]


def test_ward_with_copies_beyond_the_matrix(spark, monkeypatch):
    base = {1: "abc", 2: "abd", 3: "xy", 4: "xyz", 5: "q"}
    rows_ = [(i + 10 * c, code) for c in range(3) for i, own in base.items() for code in own]
    o = spark.createDataFrame(rows_, "response_id long, code string")
    trees = []
    for most in (5000, 4):  # 15 responses of 5 kinds, with and without a matrix
        monkeypatch.setattr(clustering, "MOST", most)
        steps = rows(clustering.ward(o), "stage", "left", "right", "size", "distance")
        assert [x[0] for x in steps] == list(range(1, 15)) and [x[4] for x in steps[:10]] == [0.0] * 10
        inside = {k: {k} for k in range(15)}
        for stage, left, right, size, _ in steps:
            inside[14 + stage] = inside.pop(left) | inside.pop(right)
            assert len(inside[14 + stage]) == size
        assert len(inside) == 1
        trees.append([x[4] for x in steps])
        got = {r["response_id"]: r["cluster"] for r in clustering.cluster_responses(o, 3)[0].collect()}
        assert got == {i + 10 * c: {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}[i] for c in range(3) for i in base}
        assert len({r["cluster"] for r in clustering.cluster_responses(o, 7)[0].collect()}) == 7
    assert trees[0] == pytest.approx(trees[1])


def test_near_duplicate_leaves_meet_in_parts(spark, monkeypatch):
    import random

    r = random.Random(3)
    held = [(f"{r.choice(['a', 'b', 'é'])}-{k}", [r.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [("bare", [1.0, 0.0, 0.5, 0.0]), ("a", [0.0, 1.0, 1.0, 0.0]), ("b-zero", [0.0] * 4), ("b-short", [1.0]), ("b-none", None)]
    leaves = spark.createDataFrame(held, "name string, vector array<float>")
    # vectors that are missing or of another length have no cosine
    x, y = (leaves.where(F.size("vector") == 4).select(F.col("name").alias(n), F.col("vector").alias(v)) for n, v in (("name_a", "va"), ("name_b", "vb")))
    meet = texts.cosine("va", "vb") >= 0.4
    family = F.substring_index("name_a", "-", 1) == F.substring_index("name_b", "-", 1)
    bare = (F.instr("name_a", "-") == 0) | (F.instr("name_b", "-") == 0)
    want = rows(x.join(y, F.col("name_a") < F.col("name_b")).where((family | bare) & meet).withColumn("score", texts.cosine("va", "vb")), "name_a", "name_b", "score")
    monkeypatch.setattr(similarity, "PART", 7)
    monkeypatch.setattr(similarity, "CHUNK", 5)
    found = similarity.near_duplicate_leaves(leaves, 0.4)
    assert rows(found, "name_a", "name_b", "score") == want and len(want) > 50
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()  # no expression per pair


def test_placing_segments(spark):
    corpus = spark.createDataFrame([(1, "The new tools save us a lot of time in the office."), (2, "We met at noon. We met at noon."), (3, "We met at noon, they said.")], "response_id long, content string")
    pairs = spark.createDataFrame([(1, "t", "tools save us a lot"), (2, "m", "We met at noon"), (3, "t", "tools saved us a lot of"), (4, "t", "nowhere to be found in it"), (5, "s", "they said"), (6, "s", "We met at noon"), (7, "t", "tim")], "row long, tag string, content string")
    got = {r["row"]: (r["response_id"], r["mode"]) for r in segments.place(pairs, corpus).collect()}
    assert got == {1: (1, "exact"), 2: (None, "ambiguous"), 3: (1, "fuzzy"), 4: (None, "unlocated"), 5: (3, "exact"), 6: (3, "resolved"), 7: (1, "exact")}


def test_placing_segments_without_a_run_in_common(spark):
    quote = "seven old men watch the river from a stone wall and say nothing for a long while"
    spaced = "".join(c if k % 4 else f"{c}#" for k, c in enumerate(quote) if c != "#").replace(" #", " ")
    corpus = spark.createDataFrame([(1, f"before {spaced} after"), (2, "seven old men")], "response_id long, content string")
    got = segments.place(spark.createDataFrame([(1, "t", quote)], "row long, tag string, content string"), corpus).collect()
    assert [(r["response_id"], r["mode"]) for r in got] == [(1, "fuzzy")]


def test_segments_and_duplicates(spark):
    r = spark.createDataFrame([(1, "One two three. Four five six."), (2, "One two three.  Four five six."), (3, None)], "response_id long, content string")
    s = segments.segment_responses(r.where("response_id = 1"))
    assert rows(s, "ordinal", "text") == [(0, "One two three."), (1, "Four five six.")]
    assert {x["response_id"]: x["duplicate_of"] for x in segments.duplicates(r).collect()} == {1: None, 2: 1, 3: None}


def test_withheld(spark):
    secret = spark.createDataFrame([("the quick brown fox jumps over it",), ("tiny",)], "text string")
    t = spark.createDataFrame([(1, "see THE  QUICK brown fox jump"), (2, "the quick brown"), (3, "Tiny"), (4, "tiny words are fine")], "id long, text string")
    assert rows(withheld.first_hits(t, secret, "id"), "id", "at") == [(1, 4), (3, 0)]


def test_clusters(spark):
    o = spark.createDataFrame([(r, c) for r in range(1, 5) for c in ("a", "b")] + [(r, c) for r in range(5, 9) for c in ("x", "y", "z")], "response_id long, code string")
    labels, told = clustering.cluster_responses(o, 2)
    assert rows(labels, "response_id", "cluster") == [(k, 1 if k < 5 else 2) for k in range(1, 9)] and told["source"] == "override"
    m = {(r["cluster"], r["code"]): r["mean"] for r in occurrence.cluster_means(o, labels).collect()}
    assert m[1, "a"] == 1 and m[1, "x"] == 0
    codes = spark.createDataFrame([("a", "time plans"), ("b", "time plans"), ("x", "trust")], "name string, description string")
    assert rows(clustering.affinity(codes, o), "name", "group_size") == [("a", 2), ("b", 2), ("x", 1)]
    with pytest.raises(ValueError):
        clustering.ward(o.where("response_id = 1"))


def test_lexical_validation(spark):
    import random

    from codeloom.config import LexicalSettings

    r = random.Random(1729)
    words = ["river", "garden", "paper", "window", "letter", "stone"]
    made = []
    for k in range(120):
        score = k % 6
        made.append((k, " ".join(r.choices(words, k=8)) + (" worry" if score >= 3 else "") + (" hope" if score == 0 else ""), score))
    scored = spark.createDataFrame(made, "response_id long, text string, score long")
    got = lexical.validate(scored, LexicalSettings(bootstraps=4, folds=2))
    top = {(x["target"], x["space"]): x["term"] for x in got.where("rank = 1").collect()}
    assert top["ge3", "presence"] == "worry" and top["ge1", "presence"] == "hope" and len(top) == 6
    assert got.where("target = 'ge3' and term = 'worry'").agg(F.min("stability")).first()[0] == 1
    with pytest.raises(ValueError):
        lexical.validate(scored.where("score > 1"), LexicalSettings(bootstraps=1))


def test_rules_are_values():
    assert CodingRules(tau_high=0.9).tau_high == 0.9 and CodingRules() == CodingRules()


def test_markers_of_one_candidate_are_those_of_the_schema_check(spark):
    quotes = [[], ["Said  it"], ["ＳAID it", "x"], ["", "other"], ["  said it"], ["é said it"]]
    made = [(1, "A", k, n, d, q) for k, (n, d, q) in enumerate((n, d, q) for n in ("fam-x", "", "  ", "\t") for d in ("said it", "", " ", "İ", "Straße") for q in [*quotes, ["STRASSE"], ["i̇"]])]
    c = spark.createDataFrame(made, "response_id long, coder string, ordinal int, name string, description string, quotes array<string>")
    kept, found = checks.s1_schema(c.drop("quotes"), c.select(*checks.KEY, F.explode("quotes").alias("quote")))
    own = [checks.s1_markers(n, d, q) for *_, n, d, q in made]
    assert rows(found.select(F.get_json_object("data", "$.marker").alias("m")), "m") == sorted((m,) for marks in own for m in marks)
    assert rows(kept, "ordinal") == [(k,) for k, marks in enumerate(own) if not {"missing_name", "missing_evidence"} & {*marks}]


def test_firsts_are_the_responses_without_a_former(spark):
    r = spark.createDataFrame([(3, "a  b"), (1, "c"), (2, "a b "), (4, None), (9, ""), (5, "C"), (7, "c"), (None, "lone")], "response_id long, content string")
    assert rows(segments.firsts(r), "response_id") == [(1,), (2,), (4,), (5,)]
    assert rows(segments.firsts(r), "response_id") == rows(segments.duplicates(r).where("duplicate_of is null and response_id is not null"), "response_id")
