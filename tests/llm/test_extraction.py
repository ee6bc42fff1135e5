import random

from codeloom.llm import extraction as ex
from codeloom.llm.html_blocks import blocks

PAGES = "page_id long, url string, html string"
SHELL = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>Away</a></ul></nav>{}<footer>&copy; all</footer><script>var a='</p>';</script></body></html>"


def one(spark, html):
    return ex.extract(spark.createDataFrame([(1, "http://h/x", html)], PAGES)).first()["text"]


def test_blocks_and_references(spark):
    html = SHELL.replace("{}", "<div class=ad>Buy</div><article><h1>Title &amp; more</h1><p>First\n  line <b>bold</b>er<br>next<p>Second &lt;x&gt; &#233;<div class='comments'><p>Reader says</div><form>Name <input></form></article>")
    assert one(spark, html) == "Title & more First line bolder next Second <x> é"


def test_broken_pages(spark):
    for html, want in [
        (None, ""), ("", ""), ("plain text only", "plain text only"), ("<article><p>cut off &am", "cut off &am"), ("<article><p>a<p>b<foo", "a b"),
        ("<article>5 < 6 and 7 > 3</article>", "5 < 6 and 7 > 3"), ("<article><p><b>x<br><p>y</article><p>z", "x y"), ("<article><!-- gone -->a<script>if(a<b){}</script>b</article>", "a b"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<main><p>m</p></main><p>o</p>", "m"), ("<article></article>", ""), ("<article><p>un</closed", "un"),
    ]:
        assert one(spark, html) == want, html
    assert one(spark, "<article>" + "<p>x " * 50_000).count("x") == 50_000


def host_pages(n, host, body, start=0):
    r = random.Random(start)
    prose = lambda: " ".join(r.choice(["river", "stone", "letter", "window", "garden"]) + str(r.randint(0, 999)) for _ in range(40))
    out, want = [], []
    for k in range(n):
        text = [prose(), prose()]
        out.append((start + k, f"http://{host}/{k}", body.format(*text)))
        want.append(" ".join(text))
    return out, want


def test_template_finds_the_slot_where_markup_names_nothing(spark):
    body = "<html><body><div class=a1><p>Welcome to the site of sites</p></div><div class=q7><div class=q8><p>{0}</p><p>{1}</p></div></div><div class=z9><p>All rights are kept by us</p><p>Follow the links below here</p></div></body></html>"
    rows, want = host_pages(20, "plain.example", body)
    one_host = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as host", "1 as token")
    for most in (ex.MOST_BROADCAST, 0):
        got = {r["page_id"]: r["text"] for r in ex.extract(one_host, most).collect()}
        assert [got[k] for k in range(20)] == want


def test_boilerplate_inside_articles_goes_and_copies_stay(spark):
    rows, want = host_pages(20, "boiler.example", "<article><p>{0}</p><p>Share this with all of your friends</p><p>{1}</p></article>")
    copies = [(100 + k, f"http://copy.example/{k}", "<article><p>The same text on every page</p></article>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in ex.extract(spark.createDataFrame(rows + copies + copies[:1], PAGES)).collect()}
    assert [got[k] for k in range(20)] == want
    assert all(got[100 + k] == "The same text on every page" for k in range(20))


def test_row_counts(spark):
    rows = [(1, None, None), (1, None, None), (2, "bad url", "<p>x</p>"), (None, "http://h/1", "<article>y</article>")]
    got = ex.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "y"), (1, ""), (1, ""), (2, "x")]
    assert ex.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_paths():
    got = blocks("<div class='x y'><section><p>a</section></div>")
    assert [(b.path, b.text) for b in got] == [(">div.x>section>p", "a")]


def neutral(html):
    """The page with the names of its parts replaced by such that say nothing."""
    for name, other in (("article", "section"), ("nav", "div class=q1"), ("footer", "div class=q2")):
        html = html.replace(f"<{name}>", f"<{other}>").replace(f"</{name}>", f"</{other.split()[0]}>")
    return html.replace('class="ad"', 'class="q3"')


def test_template_decides_on_the_sample_pages_when_their_markup_names_nothing(spark):
    """With the names gone, templates still find the articles; switched off, the markup alone takes more or less."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in ex.extract(pages, deduce=False).collect()}
    rows = [(r["page_id"], r["url"], neutral(r["html"] or "")) for r in pages.collect()]
    named = spark.createDataFrame(rows, PAGES)
    with_templates = {r["page_id"]: r["text"] for r in ex.extract(named).collect()}
    without = {r["page_id"]: r["text"] for r in ex.extract(named, deduce=False).collect()}
    right = lambda got: sum(got[k] == want[k] for k in want) / len(want)
    assert right(with_templates) > right(without) and right(with_templates) >= 0.9, (right(with_templates), right(without))


def naive_main(htmls):
    """The deepest element path, once on every page, around 0.6 of the text outside links and texts that all pages have."""
    pages = [blocks(h) for h in htmls]
    fixed = set.intersection(*[{(b.path, b.text) for b in p} for p in pages])
    once, mass = None, {}
    for p in pages:
        count = {}
        for b in p:
            for path, number in zip(ex.parts(b.path), b.ids):
                count.setdefault(path, set()).add(number)
                if (b.path, b.text) not in fixed:
                    mass[path] = mass.get(path, 0) + len(b.text) - b.links
        alone = {k for k, v in count.items() if len(v) == 1}
        once = alone if once is None else once & alone
    full = [p for p in once if p[p.rfind(">") + 1 :].partition(".")[0] not in ex.PIECES and mass.get(p, 0) >= 0.6 * max(mass.get(q, 0) for q in once)]
    return max(full, key=lambda p: p.count(">")), fixed


def test_main_slot_equals_naive_deduction(spark):
    r = random.Random(2)
    word = lambda: r.choice(["river", "stone", "letter", "window"]) + str(r.randint(0, 999))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for site in range(8):
        names = [f"k{site}{c}" for c in "abcde"]
        order = r.sample(range(3), 3)
        for k in range(12):
            zones = [
                f"<div class={names[0]}>" + "".join(f"<p><a href=x>{word()}</a></p>" for _ in range(r.randint(2, 6))) + "</div>",
                f"<div class={names[1]}><div class={names[2]}>" + "".join(f"<p>{prose(20)}</p>" for _ in range(r.randint(2, 7))) + "</div></div>",
                f"<div class={names[3]}><p>Fixed words of site {site}</p><div class={names[4]}>{prose(3)}</div></div>",
            ]
            rows.append((site * 100 + k, f"http://s{site}.site{site}/{k}", "<html><body>" + "".join(zones[z] for z in order) + "</body></html>"))
    got = {x["page_id"]: x["text"] for x in ex.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for site in range(8):
        own = [x for x in rows if x[0] // 100 == site]
        main, fixed = naive_main([h for _, _, h in own])
        for key, _, html in own:
            assert got[key] == " ".join(b.text for b in blocks(html) if main in ex.parts(b.path) and (b.path, b.text) not in fixed)


def test_small_hosts_share_the_template_of_their_domain(spark):
    body = "<html><body><div class=a1><p>Welcome to the site of sites</p></div><div class=q8><p>{0}</p><p>{1}</p></div><div class=z9><p>All rights are kept by us</p></div></body></html>"
    rows, want = host_pages(12, "x", body)
    rows = [(k, f"http://s{k}.shared.example/{k}", h) for k, _, h in rows]
    got = {x["page_id"]: x["text"] for x in ex.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k] for k in range(12)] == want


def test_marks_of_very_many_pages_do_not_overflow(spark):
    big = spark.range(3).selectExpr("'h' as host", "1L as token", "0 as kind", f"{(1 << 63) - 1}L as mark")
    from pyspark.sql import functions as F

    got = big.groupBy("host").agg(F.bit_xor("mark").alias("v"), F.sum(F.col("mark").bitwiseAND(0xFFFFF)).alias("t")).first()
    assert got["v"] == (1 << 63) - 1 and got["t"] * (1 << 41) < 1 << 63
