import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators.admission import admit, assign_batches
from corpusloom.operators.packing import Effect, _block_effect, global_numbers, pack, packing_summary
from corpusloom.plans.ranking import with_rank


def greedy(sizes, limit):
    level, shard, out = 0, 0, []
    for n in sizes:
        if level > 0 and level + n > limit:
            shard, level = shard + 1, n
        else:
            level += n
        out.append(shard)
    return out


def files(spark, sizes_by_folder):
    rows = [(f, i, f"{f}/{i:06d}", n) for f, sizes in sizes_by_folder.items() for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "folder string, i int, path string, bytes long").repartition(5)


def shards(df):
    out = {}
    for r in df.orderBy("folder", "path").collect():
        out.setdefault(r.folder, []).append(r.shard)
    return out


def test_known_case(spark):
    assert shards(pack(files(spark, {"a": [5, 5, 30, 1]}), 10)) == {"a": [0, 0, 1, 2]}


def test_hot_folder_over_many_blocks(spark):
    rng = random.Random(4)
    sizes = {
        "hot": [rng.choice([0, 1, 3, 7, rng.randint(0, 150)]) for _ in range(3000)],
        "same": [10] * 500,
        "zero": [0] * 40,
        "one": [5000],
    }
    got = shards(pack(files(spark, sizes), 100, block_rows=37))
    assert got == {f: greedy(s, 100) for f, s in sizes.items()}


def test_shards_larger_than_blocks(spark):
    rng = random.Random(6)
    sizes = {"a": [rng.randint(1, 100) for _ in range(2500)], "b": [0, 0, 9], "c": [rng.randint(0, 3) for _ in range(900)]}
    got = shards(pack(files(spark, sizes), 20_000, block_rows=50))
    assert got == {f: greedy(s, 20_000) for f, s in sizes.items()}


def test_one_scope_over_several_rounds_of_composition(spark):
    """More blocks than a task composes at once, in two rounds and more; shards of less and of more than a block."""
    rng = random.Random(9)
    sizes = [rng.choice([0, 2, 9, rng.randint(0, 60), 500]) for _ in range(1400)]
    for limit, rows in ((80, 10), (3000, 7), (10**9, 9)):
        packed = pack(files(spark, {"a": sizes}), limit, scope=None, block_rows=rows)
        assert [r.shard for r in packed.orderBy("path").collect()] == greedy(sizes, limit)


def fill(sizes, level, limit):
    breaks = 0
    for n in sizes:
        if level > 0 and level + n > limit:
            breaks, level = breaks + 1, n
        else:
            level += n
    return breaks, level


def test_composed_effects_equal_the_rule():
    """Every level through effects of runs and of their compositions; no more intervals than a shard has files."""
    rng = random.Random(12)
    for turn in range(60):
        limit = rng.choice([7, 30, 200])
        parts = [[rng.choice([0, 0, 1, 3, rng.randint(0, 40)]) for _ in range(rng.randint(1, 25))] for _ in range(5)]
        whole, joint = [], None
        for part in parts:
            whole += part
            effect = _block_effect(np.array(part), limit)
            joint = effect if joint is None else joint.then(effect)
            levels = np.arange(0, 2 * limit + 50)
            got = list(zip(*(x.tolist() for x in joint(levels))))
            assert got == [fill(whole, int(level), limit) for level in levels]
            sums = np.cumsum(whole)
            assert len(joint.above) <= 1 + int((sums <= limit).sum()) + 1
            assert Effect.of(type("Row", (), joint.row()))(levels)[1].tolist() == [after for _, after in got]


def test_effects_stay_small_for_large_shards():
    """Shards of many blocks: an effect never has more intervals than the files before its first break."""
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 100, 1000) for _ in range(64)]
    limit = 10 * int(parts[0].sum())
    joint, most = _block_effect(parts[0], limit), 0
    for part in parts[1:]:
        joint = joint.then(_block_effect(part, limit))
        most = max(most, len(joint.above))
    assert most <= 11_000


def test_shards_respect_the_limit(spark):
    rng = random.Random(5)
    packed = pack(files(spark, {"a": [rng.randint(1, 120) for _ in range(400)]}), 100)
    assert packed.count() == 400
    assert packing_summary(packed, "folder").where("bytes > 100 and files > 1").count() == 0


def test_global_numbers_are_dense(spark):
    packed = pack(files(spark, {"a": [60] * 3, "b": [60] * 2}).withColumn("o", F.col("folder")), 100)
    numbered = global_numbers(packed, "folder", "o")
    assert sorted(r.shard for r in numbered.collect()) == [0, 1, 2, 3, 4]
    assert {r.folder for r in numbered.where("shard > 2").collect()} == {"b"}


def test_rank_in_a_hot_group(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    ranked = with_rank(rows.repartition(9), ["id"], ["g"])
    assert ranked.where("g = 'hot' and rank <> id / 3 + 1").count() == 0
    assert ranked.where("g <> 'hot' and rank <> 1").count() == 0
    assert ranked.count() == 20000


def test_global_rank(spark):
    ranked = with_rank(spark.range(1000).repartition(6), [F.col("id").desc()])
    assert ranked.where("rank <> 1000 - id").count() == 0


def test_limits_follow_the_argument_order(spark):
    manifest = spark.createDataFrame(
        [("A/1", "A", 1, 1), ("A/2", "A", 1, 1), ("B/1", "B", 0, 1), ("B/2", "B", 0, 1)],
        "path string, folder string, folder_ord int, bytes long",
    )
    taken = admit(manifest, per_folder=1, total=2).orderBy("folder_ord").collect()
    assert [r.path for r in taken] == ["B/1", "A/1"]
    batches = {r.path: r.batch for r in assign_batches(manifest, 2).collect()}
    assert batches == {"B/1": 0, "B/2": 0, "A/1": 1, "A/2": 1}


def test_group_limit_comes_before_the_shuffle(spark):
    from corpusloom.operators.admission import limit_per_folder
    from tests.conftest import plan_of

    spark.range(1000).selectExpr("id % 5 as folder", "cast(id as string) as path").write.mode("overwrite").parquet(
        path := spark.conf.get("spark.checkpoint.dir") + "/limit-test"
    )
    plan = plan_of(limit_per_folder(spark.read.parquet(path), 3))
    assert plan.count("WindowGroupLimit") == 2


def test_many_small_blocks_and_a_null_folder(spark):
    sizes = {"A": [3, 9, 4, 4, 1, 12, 2] * 9, None: [5, 5, 1, 7] * 6}
    got = pack(files(spark, sizes), 10, block_rows=2).orderBy("folder", "i").collect()
    assert {f: [r.shard for r in got if r.folder == f] for f in sizes} == {f: greedy(s, 10) for f, s in sizes.items()}
