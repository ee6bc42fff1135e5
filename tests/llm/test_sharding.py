from collections import Counter

from pyspark.sql import functions as F

from codeloom.llm import sharding as sd


def brute_table(shards, size):
    import hashlib

    prefer = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefer.append(iter([(a + j * b) % size for j in range(size)]))
    owner = {}
    while len(owner) < size:
        for k, p in enumerate(prefer):
            slot = next((x for x in p if x not in owner), None)
            if slot is None or len(owner) == size:
                break
            owner[slot] = k
    return [owner[k] for k in range(size)]


def test_table_equals_brute_force_and_is_even():
    for n, size in ((1, 7), (3, 101), (7, 251), (16, 1021)):
        names = sd.shard_names(n)
        table = sd.lookup_table(names, size)
        assert table == brute_table(names, size)
        assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = sd.shard_names(20)
    before, after = sd.lookup_table(names, 2039), sd.lookup_table(names[:-1], 2039)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.15 * 2039


def test_placement(spark):
    names = sd.shard_names(5)
    table = sd.lookup_table(names, 101)
    rows = [(k, "x") for k in range(200)] + [(7, "y"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, slot string")
    got = sd.shard(df, "doc_id", names, 101).collect()
    slots = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(101))).collect()}
    assert len(got) == len(rows)
    assert all(r["slot"] == slots[r["doc_id"]] and r["shard"] == table[r["slot"]] for r in got)
    assert sd.shard(df.limit(0), "doc_id", names, 101).count() == 0
    plan = sd.shard(df, "doc_id", names, 101)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
