import random

from codeloom.llm import decontaminate as dc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A train leaves Berlin at 9 and travels 120 km in 3 hours before Anna gets on; how fast did the whole train go on this part of the way?"


def tables(spark):
    r = random.Random(8)
    noise = lambda n: " ".join(f"w{r.randint(0, 500)}" for _ in range(n))
    plain = " ".join(f"item{k}" for k in range(30))
    other = ITEM.replace("9", "7").replace("120", "450").replace("3 hours", "5 hours").replace("Berlin", "Madrid").replace("Anna", "Paolo")
    rows = [
        (1, f"{noise(50)}. {ITEM} {noise(50)}"), (2, f"{noise(20)}. {other} {noise(9)}"), (3, noise(300)), (4, None), (5, ""),
        (6, f"{noise(5)} {plain} {noise(5)}"), (7, " ".join(plain.split()[:12]) + " " + noise(40)), (8, f"x {plain}"), (8, f"x {plain}"),
        (9, "Then Anna met Paolo and Maria at 9 and at 10 and at 11 in Berlin"),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "0 as item_id")
    bench = spark.createDataFrame([(10, ITEM), (11, plain), (12, "too short"), (13, None), (14, plain)], "item_id long, text string")
    return docs, bench


def test_finds_copies_and_other_parameters_and_leaves_the_rest(spark):
    docs, bench = tables(spark)
    want = [(1, 10), (2, 10), (6, 11), (6, 14), (8, 11), (8, 11), (8, 14), (8, 14)]
    for block in (dc.BLOCK, 1):
        got = dc.contaminated(docs, bench, block=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
        changed = {(r["doc_id"], r["item_id"]): r["n_changed_slots"] for r in got}
        assert changed[1, 10] == 0 and changed[2, 10] >= 4
        clean = dc.clean(docs, bench, block=block)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 7, 9]


def test_slots_must_be_consistent():
    assert dc.consistent([(1, 5, 7), (1, 5, 7), (1, 6, 8)])
    assert not dc.consistent([(1, 5, 7), (1, 5, 9), (1, 5, 11)])
    assert not dc.consistent([(1, 5, 7), (1, 6, 7), (1, 8, 7)])


def test_empty_tables(spark):
    docs, bench = tables(spark)
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.clean(docs, bench.limit(0)).count() == 10


def test_words_are_kept_within_a_bound(monkeypatch):
    monkeypatch.setattr(dc.Lexicon, "MOST", 4)
    lex = dc.Lexicon()
    for text in ("alpha beta gamma delta eps zeta", "alpha beta", "eta theta iota kappa lam mu"):
        assert dc.canonical(text, lex)[0].tolist() == dc.canonical(text, dc.Lexicon())[0].tolist()


PAYS = "At the fair Anna pays 12 coins for 3 red apples and then she gives Anna back 12 of the coins that were left in the old bag"


def test_a_variant_before_a_copy_does_not_hide_it(spark):
    other = PAYS.replace("Anna", "Paul").replace("12", "30").replace("3 red", "8 red")
    half = " ".join(other.split()[:14])
    inserted = PAYS.replace("apples and", "apples today and")
    texts = [f"{half} . {PAYS}", f"{half} x. {half} y. {inserted} end", f"{half} . {half}", f"{other} . {PAYS}"]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(1, PAYS)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.contaminated(docs, bench).collect()) == [0, 1, 3]
    assert [r["doc_id"] for r in dc.clean(docs, bench).collect()] == [2]


BAG = "Anna has 12 red apples in a bag. Paul takes 5 of them out and walks 5km to the old mill. Anna then buys 7 more for 3kg of flour. How many apples are there in the bag now?"


def test_names_that_begin_sentences_and_units_glued_to_numbers(spark):
    names = BAG.replace("Anna", "Maria").replace("Paul", "Peter")
    units = BAG.replace("5km", "8 miles").replace("3kg", "40 g")
    chance = BAG.replace("Anna has", "Maria has").replace("Anna then", "Olga then").replace("Paul", "Maria").replace("12", "9").replace("5", "9").replace("7", "9")
    texts = [BAG, names, units, names.replace("5km", "9 m").replace("3kg", "2lb"), f"so says {names}", chance]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(1, BAG)], "item_id long, text string")
    got = {r["doc_id"]: r["n_changed_slots"] for r in dc.contaminated(docs, bench).collect()}
    assert set(got) >= {0, 1, 2, 4} and 5 not in got and got[0] == 0 and got[1] == 3
    lex = dc.Lexicon()
    assert dc.canonical("5km, (12kg) 3D x", lex)[0].tolist()[:4] == [dc.NUMBER, dc.UNIT, dc.NUMBER, dc.UNIT]


def found(spark, texts, items):
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect())


def test_a_look_alike_in_front_does_not_claim_the_windows(spark):
    item = "she pays 12 dollars for 30 boxes and each box holds 8 red apples from the hill"
    like = "she pays 99 dollars for 77 boxes and each box holds 55 red apples . "
    assert found(spark, [like + item, "so " + item, like], [item]) == [(0, 0), (1, 0)]


def test_short_items_and_items_of_placeholders_match_by_their_values(spark):
    items = ["Paris", "what is", "what is 2", "what is 2 plus", "1 2 3 4 5 6 7 8", "", None]
    texts = ["Paris!", "I like Paris a lot", "tell me what is 2 plus and go", "what is 3 plus", "say 1 2 3 4 5 6 7 8 now", "say 8 2 3 1 5 6 9 9 now", "", None]
    assert found(spark, texts, items) == [(0, 0), (2, 1), (2, 2), (2, 3), (3, 1), (4, 4)]


def test_windows_scattered_over_a_long_text_do_not_add_up(spark):
    r = random.Random(3)
    words = [f"item{k}" for k in range(30)]
    noise = lambda n: [f"w{r.randint(0, 500)}" for _ in range(n)]
    parts = [w for k in range(0, 26, 2) for w in [*words[k : k + 6], *noise(200)]]
    assert found(spark, [" ".join(parts), " ".join([*noise(9), *words])], [" ".join(words)]) == [(1, 0)]


NAMES = "Anna Paul Maria Peter Olga Bruno Clara Dario Elsa Franz".split()
UNITS = "km kg hours days euros miles".split()


def template(r):
    """A question as a function of its parameters, and how many it takes."""
    verbs, nouns = [f"verb{r.randint(0, 99)}s" for _ in range(9)], [f"noun{r.randint(0, 99)}" for _ in range(9)]
    v, n = iter(verbs), iter(nouns)
    return lambda a, b, x, y, u: f"When {a} {next(v)} the {next(n)} for {x} {u} and then {b} {next(v)} all of the {next(n)} in the {next(n)}, how many {next(n)} will {a} {next(v)} after {y} {u} of the {next(n)} that they {next(v)}?"


def naive(doc, item):
    """Whether some alignment of item to doc, token by token, agrees in 0.8 of the windows of 5 with one-to-one slots."""

    def read(text):
        out, start, number = [], True, False
        for raw in text.split():
            bare = raw.strip(".,?!:;")
            kind = "#" if bare.isdigit() else "u" if bare in UNITS and number else "N" if bare[:1].isupper() and not start else ""
            out.append((kind or bare.lower(), bare.lower(), bool(kind)))
            start, number = raw[-1] in ".!?:;", kind == "#"
        return out

    d, t = read(doc), read(item)
    n = len(t) - 4
    for o in range(-n, len(d)):
        good = [i for i in range(n) if 0 <= o + i <= len(d) - 5 and [x[0] for x in t[i : i + 5]] == [x[0] for x in d[o + i : o + i + 5]]]
        if len(good) < 0.8 * n:
            continue
        pairs = {(t[k][0], t[k][1], d[o + k][1]) for i in good for k in range(i, i + 5) if t[k][2]}
        if len({p[:2] for p in pairs}) == len(pairs) == len({(p[0], p[2]) for p in pairs}):
            return True
    return False


def test_equals_brute_force_on_questions_with_other_parameters(spark):
    r = random.Random(11)
    draw = lambda: (*r.sample(NAMES, 2), *r.sample(range(2, 900), 2), r.choice(UNITS))
    items, texts, of = [], [], {}
    for k in range(40):
        p, q = draw(), draw()
        seed = r.randint(0, 1 << 30)
        items.append(template(random.Random(seed))(*p))
        again = template(random.Random(seed))(*q)
        noise = lambda n: " ".join(f"w{r.randint(0, 500)}" for _ in range(n))
        of[len(texts)] = k
        texts += [f"{noise(30)}. {again} {noise(30)}", f"{noise(9)} {' '.join(again.split()[:12])} {noise(9)}", again.replace(" and then ", f" {noise(60)} ")]
    got = found(spark, texts, items)
    assert got == [(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if naive(t, i)]
    assert sum((d, k) in got for d, k in of.items()) >= 0.9 * len(of)
