from pyspark.sql import functions as F

from shelfwise.llm.common import join_lookup, let, materialize


def test_salted_join_equals_broadcast(spark):
    big = spark.createDataFrame([(k, "hot" if k % 3 else None, k % 5) for k in range(300)], "id long, a string, b long")
    small = spark.createDataFrame([("hot", 0, "x"), ("hot", 3, "y"), (None, 1, "z"), ("other", 2, "w")], "sa string, sb long, v string")
    want = sorted(map(tuple, join_lookup(big, small, [("a", "sa"), ("b", "sb")]).select("id", "v").collect()), key=str)
    got = sorted(map(tuple, join_lookup(big, small, [("a", "sa"), ("b", "sb")], limit_rows=0, salts=5).select("id", "v").collect()), key=str)
    assert got == want and len(got) == 300
    assert join_lookup(big, small, [("a", "sa"), ("b", "sb")], limit_rows=0).columns == join_lookup(big, small, [("a", "sa"), ("b", "sb")]).columns


def test_let_evaluates_once_and_tables_are_reread(spark):
    df = materialize(spark.range(3).withColumn("r", F.rand()), "random")
    assert sorted(r.r for r in df.collect()) == sorted(r.r for r in df.collect())
    assert [r.x for r in spark.range(1).select(let(F.array(F.lit(3), F.lit(4)), lambda a: a[0] + a[1]).alias("x")).collect()] == [7]
