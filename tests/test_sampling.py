import math

from pyspark.sql import functions as F

from corpusloom.operators.sampling import length_batches, shuffled, with_split
from corpusloom.operators.admission import first_n, row_with


def test_split_sizes(spark):
    for n in (0, 1, 19, 20, 21, 40, 1000):
        rows = with_split(spark.range(n), "id")
        counts = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
        assert counts.get("test", 0) == math.ceil(round(n * 0.05, 9))
        assert sum(counts.values()) == n


def test_split_depends_on_seed_and_key_only(spark):
    def test_ids(df, **options):
        return {r.id for r in with_split(df, "id", **options).where("split = 'test'").collect()}

    base = test_ids(spark.range(2000))
    assert base == test_ids(spark.range(2000).repartition(11))
    assert base != test_ids(spark.range(2000), seed=4)
    train = with_split(spark.range(2000), "id").where("split = 'train'")
    assert train.where(F.col("id").isin(list(base))).count() == 0


def test_shuffle_is_a_permutation(spark):
    placed = shuffled(spark.range(500).repartition(4), "id")
    assert sorted(r.position for r in placed.collect()) == list(range(500))


def test_batches_have_equal_rows_and_close_lengths(spark):
    rows = spark.range(1003).withColumn("len", F.pmod(F.hash("id"), F.lit(700)))
    placed = length_batches(rows, "id", "len")
    sizes = [r["count"] for r in placed.groupBy("batch").count().collect()]
    assert max(sizes) == 4 and sum(sizes) == 1003
    spread = placed.groupBy("batch").agg((F.max("len") - F.min("len")).alias("d")).agg(F.avg("d")).first()[0]
    assert spread < 30


def test_first_n_is_stable(spark):
    rows = spark.range(100).repartition(5)
    assert [r.id for r in first_n(rows, "id", 3).collect()] == [0, 1, 2]
    assert [r.id for r in row_with(rows, "id", 9).collect()] == [9]
