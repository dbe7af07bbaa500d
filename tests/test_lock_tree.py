"""A23 as a tree: a changed id is located; W1: a frequent key's join is split."""

import hashlib

from pyspark.sql import functions as F

from corpusgauge.operators import quality as Q
from corpusgauge.operators.common import shared_table


def prefix(i, levels):
    return hashlib.sha256(str(i).encode()).hexdigest()[:levels]


def test_one_changed_id_among_many_is_located(spark):
    ids = spark.range(1_000_000).select(F.col("id").alias("i"))
    lock = shared_table(Q.lock_tree(ids, "i", 3), "lock")
    assert lock.filter("level = 3").count() == 16 ** 3 and lock.filter("level = 0").first()["n"] == 1_000_000
    now = shared_table(Q.lock_tree(ids.select(F.when(F.col("i") == 123_456, F.lit(5_000_000)).otherwise(F.col("i")).alias("i")), "i", 3), "now")
    got = {r["prefix"]: r["n_now"] - r["n_locked"] for r in Q.changed_leaves(now, lock).collect()}
    assert got == {prefix(123_456, 3): -1, prefix(5_000_000, 3): 1}
    assert Q.changed_leaves(lock, lock).count() == 0


def test_repeats_nulls_and_empty_sets(spark):
    rows = [(1,), (2,), (2,), (None,)]
    df = spark.createDataFrame(rows, "i long")
    lock = shared_table(Q.lock_tree(df, "i", 2), "lock")
    assert lock.filter("level = 0").first()["n"] == 3
    again = Q.lock_tree(df.repartition(5).orderBy(F.desc("i")), "i", 2)
    assert Q.changed_leaves(shared_table(again, "again"), lock).count() == 0
    once = shared_table(Q.lock_tree(df.distinct(), "i", 2), "once")   # a lost repeat is a change
    assert [r["prefix"] for r in Q.changed_leaves(once, lock).collect()] == [prefix(2, 2)]
    none = shared_table(Q.lock_tree(df.limit(0), "i", 2), "none")
    assert {r["prefix"] for r in Q.changed_leaves(none, lock).collect()} == {prefix(1, 2), prefix(2, 2)}
    assert {r["prefix"] for r in Q.changed_leaves(lock, none).collect()} == {prefix(1, 2), prefix(2, 2)}


def test_a_frequent_key_is_split(spark):
    n = 60_000
    df = shared_table(spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20_000).cast("string")))
                                            .alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("pad")).repartition(40), "rows")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                                "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(old, ("-1", "64k", "1.5", "64k")):
            spark.conf.set(k, v)
        out = Q.first_occurrence_flag(df, "key", "id")
        assert out.filter("is_dup").count() == n - 1 - out.select("key").distinct().count() + 1
        rows = out.select("id", "pad", "is_dup")
        rows.write.format("noop").mode("overwrite").save()
        df2 = out.select("id", "pad", "is_dup")
        df2.collect()
        plan = df2._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
