"""Snapshots that resume and states that merge."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from cinderlake.functions.snapshots import Snapshots, iterate
from cinderlake.operators import tilestats as T


def double(df, k):
    return df.select("id", (F.col("v") * 2 + k).alias("v"))


def start(spark):
    return lambda: spark.range(50).select("id", F.col("id").cast("double").alias("v"))


def values(df):
    return [r.v for r in df.orderBy("id").collect()]


def plain(rounds):
    out = [float(i) for i in range(50)]
    for k in range(1, rounds + 1):
        out = [v * 2 + k for v in out]
    return out


def test_a_killed_job_goes_on(spark, tmp_path):
    path, seen = str(tmp_path / "job"), []

    def step(df, k):
        seen.append(k)
        if k == 3 and seen.count(3) == 1:
            raise RuntimeError("killed")
        return double(df, k)

    run = lambda: iterate(spark, path, start(spark), step, lambda df, k: k == 5)
    with pytest.raises(RuntimeError, match="killed"):
        run()
    assert values(run()) == plain(5) and seen == [1, 2, 3, 3, 4, 5]
    assert Snapshots(spark, path).rounds() == [4, 5]
    assert values(run()) == plain(5) and seen[-1] == 5 and len(seen) == 6  # nothing is left to do


def test_a_table_without_a_record_does_not_count(spark, tmp_path):
    path = str(tmp_path / "job")
    iterate(spark, path, start(spark), double, lambda df, k: k == 2)
    spark.range(3).write.parquet(f"{path}/3")  # written when the job was killed
    assert values(iterate(spark, path, start(spark), double, lambda df, k: k == 3)) == plain(3)


@pytest.mark.parametrize("harm", ["flip", "cut", "lose", "swap"])
def test_a_bad_snapshot_falls_back_a_round(spark, tmp_path, harm):
    path = str(tmp_path / "job")
    iterate(spark, path, start(spark), double, lambda df, k: k == 4)
    files = [f for f in glob.glob(f"{path}/4/*.parquet") if os.path.getsize(f) > 400]
    with open(files[0], "rb") as f:
        raw = bytearray(f.read())
    for extra in glob.glob(f"{path}/4/.*.crc"):
        os.remove(extra)
    if harm == "flip":
        raw[4:80] = bytes(b ^ 0x55 for b in raw[4:80])  # the first page
    if harm == "lose":
        os.remove(files[0])
    elif harm == "swap":
        spark.range(50).select("id", F.lit(1.0).alias("v")).write.mode("overwrite").parquet(f"{path}/4")
    else:
        with open(files[0], "wb") as f:
            f.write(raw[: len(raw) // 2] if harm == "cut" else raw)
    chain = Snapshots(spark, path)
    k, df = chain.latest()
    assert k == 3 and values(df) == plain(3) and os.path.exists(f"{path}/4.bad")
    assert values(iterate(spark, path, start(spark), double, lambda df, k: k == 5)) == plain(5)


def test_states_merge_in_any_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i % 7, rng.choice([None, float("nan"), rng.gauss(50, 30), 10.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "scene string, tile int, v double").repartition(5)
    whole = {r.scene: r for r in T.states(df, ["scene"], "v", 0.0, 100.0, 64).collect()}
    tiles = T.states(df, ["scene", "tile"], "v", 0.0, 100.0, 64)
    pairs = T.merge(tiles.withColumn("pair", F.col("tile") % 3), ["scene", "pair"])
    for merged in (T.merge(tiles, ["scene"]), T.merge(pairs, ["scene"])):
        made = merged.select("*", *(c.alias(f"x_{k}") for k, c in T.summary(0.0, 100.0).items())).collect()
        for r in made:
            v = sorted(x for s, _, x in rows if s == r.scene and x is not None and x == x)
            mean = sum(v) / len(v)
            w = whole[r.scene]
            assert (r.n, r.low, r.high, list(r.bins)) == (len(v), v[0], v[-1], list(w.bins)) and sum(r.bins) == len(v)
            assert abs(r.mean - mean) < 1e-9 and abs(r.x_std - (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5) < 1e-6
            assert -1e-9 <= r.x_median - v[(len(v) - 1) // 2] <= 100 / 64 + 1e-9
    none = T.states(df.filter("tile = 99"), ["scene"], "v", 0.0, 1.0)
    assert none.count() == 0


def test_over_tiles(spark):
    df = spark.createDataFrame([("s", 1.0, None), ("s", 3.0, None), ("s", 8.0, 2.0)], "scene string, a double, b double")
    got = {r.key: r for r in T.over_tiles(df, ["scene"], ["a", "b"]).collect()}
    assert (got["a"]["sum"], got["a"]["mean"], got["a"]["median"], got["a"]["tiles"]) == (12.0, 4.0, 3.0, 3) and (got["b"]["mean"], got["b"]["tiles"]) == (2.0, 1)
