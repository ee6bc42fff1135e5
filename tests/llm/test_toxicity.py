import random

from codeloom.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_brute_force():
    r = random.Random(1)
    letters = "abc"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(3, 10))) for _ in range(25)})
    stems = ["caca", "bbbba"]
    machine = tx.Automaton(tx.Trie(words, stems))
    allowed = lambda w: 0 if len(w) < tx.FUZZY_1 else 1 if len(w) < tx.FUZZY_2 else 2
    for _ in range(3000):
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 11)))
        near = [d for t in words if (d := edits(w, t)) <= allowed(t)]
        want = 0 if any(w.startswith(s) for s in stems) else min(near, default=9)
        assert machine.distance(w) == want, w


def test_states_are_made_anew_beyond_their_bound(monkeypatch):
    monkeypatch.setattr(tx.Automaton, "MOST_STATES", 3)
    machine = tx.Automaton(tx.Trie(["horrible"], []))
    assert [machine.distance(w) for w in ("horrible", "horible", "hello", "horrrible")] == [0, 1, 9, 1]


def test_quotation():
    words = 'he said "you idiot" to them'.split()
    assert tx.quoted(words, words.index('idiot"'))
    assert not tx.quoted("you are an idiot and more".split(), 3)


def test_learning_and_misspellings(spark):
    r = random.Random(6)
    clean = lambda: " ".join(r.choice(["river", "stone", "letter", "window", "garden", "paper"]) for _ in range(30))
    bad = lambda w: clean() + " " + w + " " + clean()
    rows = [(k, bad(r.choice(["worthless", "dimwit", "scoundrel"])) if k % 2 else clean(), None, None, None) for k in range(400)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, bad("w0rthless"), None, None, None), (903, bad("scoundrell"), None, None, None), (904, clean(), None, None, None), (904, clean(), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "0.5 as score")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x["score"] for x in got}
    assert min(by[k] for k in range(1, 400, 2)) > 0.5 > max(by[k] for k in range(0, 400, 2))
    assert by[902] > by[904] and by[903] > by[904] and by[900] == by[901] == by[904]
    assert tx.fit(docs, labels.where("toxic = 0")) is None
    assert tx.score(docs, None).agg({"score": "max"}).first()[0] == 0
    assert tx.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_rare_pure_terms_stay_beside_many_frequent_ones(spark):
    common = [f"leaning{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(6200)]
    # the common words: 6 toxic rows and 3 others; the rare one: 4 toxic rows and no other
    rows = [(" ".join(common) + (" vermin" if k < 4 else ""), 1) for k in range(6)] + [(" ".join(common), 0)] * 3
    lexicon = tx.mine(spark.createDataFrame(rows, "text string, label int"))
    assert "vermin" in lexicon["words"] and "vermin" in lexicon["pure"][0] and len(lexicon["words"]) == 6201


def test_graded_tries_equal_lookups():
    r = random.Random(5)
    draw = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
    words, stems = {draw(): r.random() for _ in range(40)}, {draw(): r.random() for _ in range(20)}
    hits = tx.Hits(words, stems, ([], []))
    for _ in range(2000):
        w = draw()
        begin = max((s for s in stems if w.startswith(s)), key=len, default=None)
        assert hits.odds(w) == (words[w] if w in words else stems[begin] if begin else 0.0)


def test_very_long_texts_and_words_are_read_whole(spark):
    lexicon = {"words": {"dimwit": 3.0}, "stems": {}, "pure": (["dimwit"], [])}
    hits = tx.Hits(**lexicon)
    assert tx.features("river " * 200_000 + "dimwlt", hits)[1] > 0 and tx.features("x" * 500_000, hits) == [0.0] * tx.FEATURES
