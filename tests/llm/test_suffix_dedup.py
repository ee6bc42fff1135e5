import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from codeloom.llm import suffix_dedup as sd
from codeloom.llm.superwindows import runs, sliding_least

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = True
        edges = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int), 0]) == 1))
        out.append((len(d), int(gone.sum()), edges, sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(3)]
    line = prose(12)
    texts = [None, "", "x", prose(30), "a" * 300, "ab" * 200, prose(150), prose(150) + " " + line * 6]
    for _ in range(30):
        texts.append(" ".join([prose(r.randint(0, 40)), r.choice([*shared, line]), prose(r.randint(0, 40)), r.choice([*shared, line, ""])]))
    texts += [texts[6], texts[6], texts[6][:200] + "Z" + texts[6][200:], texts[9]]
    return texts


@pytest.mark.parametrize(("size", "group"), [(60, 8192), (60, 3), (100, 8192)])
def test_spans_equal_brute_force(spark, size, group):
    texts = corpus(size + group)
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in sd.repeated_spans(docs.repartition(5), size, group).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(brute(texts, size)):
        data, spans = (texts[k] or "").encode(), [s.asDict() for s in got[k]["spans"]]
        have = (len(data), sum(s["end"] - s["start"] for s in spans), len(spans), sha256(sd.kept(data, spans)).hexdigest())
        assert have == want, k


def test_repeated_rows_null_ids_and_empty_tables(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (None, long + "!", None, None, None), (2, None, None, None, None), (2, "other text", None, None, None)]
    got = sd.repeated_spans(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as m", "2 as t", "3 as kid"), 60).collect()
    assert len(got) == 5
    assert sorted(sum(s["end"] - s["start"] for s in r["spans"]) for r in got) == [0, 0, len(long), len(long), len(long)]
    assert sd.repeated_spans(spark.createDataFrame([], DOCS), 60).count() == 0


def test_intervals_of_a_known_suffix_array():
    text = "banana"
    order = sorted(range(6), key=lambda k: text[k:])
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [shared(text[a:], text[b:]) for a, b in zip(order, order[1:])]
    assert sorted(x for x in sd.intervals(lcp) if x[0]) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_runs_cover_each_window_once_and_follow_content():
    r = np.random.default_rng(3)
    data = bytes(r.integers(97, 100, 5000, dtype=np.uint8))
    m, t, s, n, times, at = runs(data, 80)
    assert np.array_equal(np.concatenate([np.arange(a, a + k) for a, k in zip(s, n)]), np.arange(5000 - 79))
    x = r.integers(0, 1000, 500).astype(np.uint64)
    assert np.array_equal(sliding_least(x, 17), [x[k : k + 17].min() for k in range(484)])


def test_stage_cuts_passages_of_51_words_and_leaves_those_of_50(spark):
    import corpus_pipeline as cp

    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("abcdeé") + r.choice("fgh") + f"{r.randint(0, 99)}" for _ in range(n))
    long, short = prose(51), prose(50)
    own = [(prose(30), prose(30)) for _ in range(6)]
    rows = [(k, f"{a} x{k} {long if k < 3 else short} y{k} {b}") for k, (a, b) in enumerate(own)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], DOCS)
    got = {x["doc_id"]: x for x in cp.cut_repeats(spark, docs, "").collect()}
    for k, (a, b) in enumerate(own):
        left = f"{a} x{k} y{k} {b}" if k < 3 else rows[k][1]
        assert got[k]["text"].split() == left.split() and got[k]["n_chars"] == len(got[k]["text"])


def thue_morse(n, a, b):
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(n))


@pytest.mark.parametrize("levels", [1, 4])
def test_strings_on_which_polynomial_sums_collide_and_groups_that_must_be_split(spark, levels):
    r = random.Random(levels)
    swap = lambda t: t.translate(str.maketrans("ab", "ba"))
    word = lambda: "".join(r.choice("cdef") for _ in range(4))
    tm = thue_morse(1024, "a", "b")
    frequent = "the very same phrase stands here"
    texts = [tm, swap(tm), tm[:512] + "x" + swap(tm)[:512], thue_morse(700, "ab", "ba"), thue_morse(300, "q", "r")]
    texts += [f"{' '.join(word() for _ in range(12))} {frequent} {' '.join(word() for _ in range(12))}" for _ in range(40)]
    texts += [texts[9][:90] + "!" + texts[9][90:], texts[10] + texts[11]]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in sd.repeated_spans(docs, 64, 2, levels).collect()}
    for k, want in enumerate(brute(texts, 64)):
        data, spans = texts[k].encode(), [s.asDict() for s in got[k]["spans"]]
        assert (len(data), sum(s["end"] - s["start"] for s in spans), len(spans), sha256(sd.kept(data, spans)).hexdigest()) == want, k


def test_clashing_columns_and_scripts_without_spaces(spark):
    r = random.Random(4)
    # 60 characters of a script without spaces count as 60 words
    shared = "".join(chr(0x4E00 + r.randint(0, 900)) for _ in range(60))
    rows = [(k, f"{''.join(chr(0x4E00 + r.randint(0, 900)) for _ in range(30))} x{k} {shared} y{k}", 5) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kid int").selectExpr("*", "1 as __kid", "2 as __a", "3 as spans", "4 as KTH", "5 as m", "'z' as `a.b`", "6 as passages")
    got = sd.without_repeats(docs, words=51)
    assert got.columns == docs.columns
    for x in got.collect():
        assert (x["kid"], x["__kid"], x["__a"], x["spans"], x["KTH"], x["m"], x["a.b"], x["passages"]) == (5, 1, 2, 3, 4, 5, "z", 6)
        assert x["text"].split() == [w for w in rows[x["doc_id"]][1].split() if w != shared]


def brute_passages(texts, words):
    found = [[(m.group(), m.span()) for m in re.finditer(r"\S+", t or "")] for t in texts]
    windows = lambda ws: [tuple(w for w, _ in ws[k : k + words]) for k in range(len(ws) - words + 1)]
    seen = Counter(x for ws in found for x in windows(ws))
    out = []
    for t, ws in zip(texts, found):
        hit = np.zeros(len(ws) + 2, dtype=int)
        for k, x in enumerate(windows(ws)):
            if seen[x] > 1:
                hit[k + 1 : k + 1 + words] = 1
        edges = zip(np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1))
        out.append([len(t[ws[a][1][0] : ws[b - 1][1][1]].encode()) for a, b in edges])
    return [(len(x), sum(x)) for x in out]


def test_query_tells_of_passages_of_over_50_words_under_400_bytes(spark, tmp_path):
    from codeloom.llm.queries import op6_suffix_dedup

    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 4))) for _ in range(n))
    passage, short, other, long = prose(51), prose(50), prose(70), prose(150)
    texts = [None, "", "x", prose(40)] + [f"{prose(30)} x{k} {passage} y{k} {prose(20)}" for k in range(3)]
    texts += [f"{prose(30)} x{k} {short} y{k} {prose(20)}" for k in range(3, 6)]
    # twice in one text, with other white space, next to each other, longer than 400 bytes, a copy of the whole
    texts += [f"{other} z {prose(9)} {other}", passage.replace(" ", "\n\n"), f"{passage} {other}", f"{long} u", f"v {long}", "one word " * 40, "one word " * 40]
    spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert len(passage.encode()) < 400 and got[4]["n_removed"] == 0 and (got[4]["n_passages"], got[4]["n_passage_bytes"]) == (1, len(passage.encode()))
    for k, (fixed, told) in enumerate(zip(brute(texts, 400), brute_passages(texts, 51))):
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == fixed, k
        assert (got[k]["n_passages"], got[k]["n_passage_bytes"]) == told, k


@pytest.mark.parametrize(("group", "levels"), [(2048, 4), (3, 4), (3, 1)])
def test_passages_equal_brute_force(spark, group, levels):
    texts = corpus(group + levels)
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    got = {x["doc_id"]: x["passages"] for x in sd.repeated_spans(docs, 60, group, levels, words=8).collect()}
    for k, want in enumerate(brute_passages(texts, 8)):
        assert (len(got[k]), sum(s["end"] - s["start"] for s in got[k])) == want, k


def test_a_word_has_one_code_wherever_it_stands():
    # beyond a slice of words, long words, equal polynomial sums, scripts without spaces, other white space
    tm = thue_morse(4096, "a", "b")
    swapped = tm.translate(str.maketrans("ab", "ba"))
    one = lambda w: sd.coded(w)
    assert sd.coded("b c " * 20_000) == (one("b") + one("c")) * 20_000
    assert sd.coded(f"é {tm}\n{swapped}\xa0日本 x") == b"".join(map(one, ["é", tm, swapped, "日", "本", "x"])) and one(tm) != one(swapped)
    assert sd.coded(None) == sd.coded(" \n") == b"" and len({one(f"w{k}") for k in range(1000)}) == 1000
    text = "é日 ü x\U00020000y  ñandú"
    ranges = [text.encode()[a:b].decode() for k in range(len(sd.units(text))) for a, b in sd.word_ranges(text, [4 * k], [4 * k + 4])]
    assert ranges == sd.units(text)
