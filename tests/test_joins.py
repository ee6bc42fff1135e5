from pyspark.sql import functions as F

from codeloom.operators import growth, withheld
from codeloom.operators.joins import hot_join


def test_hot_keys_by_broadcast_give_the_rows_of_a_join(spark):
    large = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 3 - 1)).alias("k"), F.col("id").alias("v"))
    small = large.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")).where("k <> 2")
    want = sorted(tuple(r) for r in large.join(small, "k").select("k", "v", "least").collect())
    for least in (0, 200, 10_000):
        got = hot_join(large, small, ["k"], "n", 3000, least)
        assert got.columns == ["k", "v", "least"] and sorted(tuple(r) for r in got.collect()) == want


def test_a_join_without_a_possible_hot_key_broadcasts_nothing(spark):
    large = spark.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = large.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hints = lambda df: df._jdf.queryExecution().logical().toString().count("broadcast")
    assert not hints(hot_join(large, small, ["k"], "n", 3000, 3000))
    assert not hints(hot_join(large, small, ["k"], "n", 3000, 500, heaviest=429))
    assert hints(hot_join(large, small, ["k"], "n", 3000, 428, heaviest=429))


def test_places_of_sparse_and_dense_ids(spark):
    ids = [*range(50), *(k * 10**15 for k in range(1, 30)), -5, 10**18]
    got = growth.place(spark.createDataFrame([(i,) for i in ids * 2], "response_id long"), bucket=7)
    assert {r["response_id"]: r["place"] for r in got.collect()} == {i: k + 1 for k, i in enumerate(sorted(ids))}
    one = growth.running(spark.createDataFrame([(i, 2) for i in ids], "k long, n int"), "k", {"total": "n"}, bucket=7)
    assert [r["total"] for r in one.orderBy("k").collect()] == [2 * (k + 1) for k in range(len(ids))]
    assert growth.place(spark.createDataFrame([], "response_id long")).count() == 0


def test_withheld_result_does_not_depend_on_the_blocks(spark):
    text = "a run of characters that is withheld from all"
    texts = spark.createDataFrame([(1, f"x {text}"), (1, f"longer {text}"), (2, "nothing of it here, whatever it says")], "id long, text string")
    held = spark.createDataFrame([(text,)], "text string")
    a, b = ([tuple(r) for r in withheld.first_hits(texts, held, "id", block=n).collect()] for n in (2_000_000, 4))
    assert a == b and len(a) == 1
