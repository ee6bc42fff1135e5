import random

import pytest

import corpus_pipeline as cp
from codeloom.llm import packing
from codeloom.llm.queries import tokenizer_path
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffix_dedup import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "what is the name of the long river that flows through the old city of stone and glass"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    words = {"aa": ["kalo", "mita", "loka", "tami", "kami"], "bb": ["schung", "keitver", "ungsch", "verkeit", "undung"]}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) + str(r.randint(0, 400)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    shared = prose("aa", 80)
    rows = [(k, prose(lang, r.randint(30, 200)), lang, "s", None) for k, lang in enumerate(r.choices(list(words), k=60))]
    rows += [(100, rows[3][1], "aa", "s", None), (101, rows[3][1], "aa", "s", None), (102, None, None, None, None), (103, "12345 !!", "aa", None, None)]
    rows += [(110 + k, f"{prose('aa', 40)} {shared} {prose('aa', 40)}", "aa", "s", None) for k in range(3)]
    rows += [(120, f"{prose('bb', 40)} {BENCH} {prose('bb', 40)}", "bb", "s", None), (121, "", "aa", "s", None), (4, rows[4][1], rows[4][2], "s", None)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*x[:4], len(x[1] or "")) for x in rows], DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "packing"]

    kept = stage["language"](spark, docs, folder)
    assert kept.columns == docs.columns
    rows1 = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(i for i, _ in rows1) == sorted(i for i, t in rows if t and any(c.isalpha() for c in t))

    kept2 = stage["near_duplicates"](spark, kept, folder)
    group = brute_components([i for i, _ in rows1], [brute_fingerprint(t, 5) for _, t in rows1], 3)
    rows2 = sorted((r["doc_id"], r["text"]) for r in kept2.collect())
    assert [i for i, _ in rows2] == sorted(set(group))

    kept3 = stage["repeats"](spark, kept2, folder)
    want = brute([t for _, t in rows2], 400)
    rows3 = {r["doc_id"]: r for r in kept3.collect()}
    assert kept3.columns == docs.columns
    for (i, t), (_, removed, _, _) in zip(rows2, want):
        assert len(t.encode()) - len(rows3[i]["text"].encode()) == removed and rows3[i]["n_chars"] == (len(rows3[i]["text"]) if removed else len(t))
    assert sum(w[1] > 0 for w in want) == 3

    kept4 = stage["decontamination"](spark, kept3, folder)
    rows4 = {r["doc_id"]: r["text"] for r in kept4.collect()}
    assert set(rows3) - set(rows4) == {120}

    packed = stage["packing"](spark, kept4, folder).collect()
    encode = packing.encoder(tokenizer_path())
    total = {}
    for p in packed:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {i: len(encode(t)) + 1 for i, t in rows4.items()}


def test_run_gives_the_last_stage(spark, folder):
    out = cp.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_empty_documents(spark, folder, tmp_path):
    where = str(tmp_path / "t")
    spark.createDataFrame([], DOCS).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{where}/benchmark.parquet")
    assert cp.run(spark, where).count() == 0
