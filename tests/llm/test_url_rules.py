from pyspark.sql import functions as F

from codeloom.llm import url_rules as ur
from codeloom.llm.queries import GIVEN_RULES


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fit = [(h + p, v) for v, h, p in GIVEN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


URLS = [None, "", "no scheme/en/", "http://A.Example.COM/en/7?q=1#x", "https://example.com/en/", "ftp://com/en/x", "http://xcom/en/", "http://b.net/de/8", "http://example.net/de/81/z", "http://example.net", "http://m.example.net?x=/de/8", "http://ü.org/es/#é", "a://b://c.com/en/", "http://org/es", "http://user.org:80/es/"]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = {r["page_id"]: r for r in ur.judge(df, GIVEN_RULES, []).collect()}
    for k, u in enumerate(URLS + URLS[:3]):
        host, path, rule, verdict = brute(u)
        r = got[k]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), u
    assert ur.judge(df.limit(0), GIVEN_RULES, []).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rows = [(k, f"http://{'casino' if k % 3 == 0 else 'news'}{k % 7}-win.example.org/{'play' if k % 2 else 'read'}/{k}") for k in range(400)]
    urls = spark.createDataFrame(rows, "id long, url string")
    bad = urls.select("id", ((F.col("id") % 3 == 0) & (F.col("id") % 2 == 1)).alias("bad"))
    mined = ur.mine(urls, bad, min_support=0.02, min_confidence=0.9)
    sets = [(set(s), c) for s, c in mined]
    assert any({"part:casino", "path:play"} == s for s, _ in sets)
    baskets = [(set(ur.tokens(u.split("/")[2], "/" + "/".join(u.split("/")[3:]), u)), i % 3 == 0 and i % 2 == 1) for i, u in rows]
    for s, c in sets:
        hit = [b for t, b in baskets if s <= t]
        assert abs(sum(hit) / len(hit) - c) < 1e-9 and c >= 0.9 and sum(hit) >= 0.02 * 400
    got = {r["page_id"]: r["verdict"] for r in ur.judge(urls.withColumnRenamed("id", "page_id"), [], mined).collect()}
    for (i, _), (t, _) in zip(rows, baskets):
        assert got[i] == ("block" if any(s <= t for s, _ in sets) else "allow")


def test_without_labels_nothing_is_mined(spark):
    urls = spark.createDataFrame([(1, "http://a.b/c")], "id long, url string")
    assert ur.mine(urls, spark.createDataFrame([], "id long, bad boolean")) == []


def test_labels_without_a_signal_give_no_rules(spark):
    rows = [(k, f"http://h{k % 37}.site{k % 11}.example.org/p{chr(97 + k % 5)}/{k}?a=1") for k in range(900)]
    urls = spark.createDataFrame(rows, "id long, url string")
    bad = urls.select("id", (F.pmod(F.xxhash64("id"), F.lit(6)) == 0).alias("bad"))
    assert ur.mine(urls, bad) == []
    assert ur.mine(urls, urls.select("id", F.lit(False).alias("bad"))) == [] == ur.mine(urls, urls.select("id", F.lit(True).alias("bad")))


def test_lower_limit_of_wilson():
    assert ur.lower_limit(0, 0) == 0 and abs(ur.lower_limit(8, 10, 1.96) - 0.4902) < 1e-3 and ur.lower_limit(5, 5) < 0.4
