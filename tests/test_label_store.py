import datetime as dt
import os

from pyspark.sql import functions as F

from citeflow.sinks import files
from citeflow.sinks.label_store import compact, init_store, read_store, upsert_into, vacuum

RUN = dt.datetime(2001, 8, 1)


def test_bucketed_upsert(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    old = spark.createDataFrame(
        [(f"p{i}", ["old"], dt.datetime(2000, 1, 1), dt.datetime(2000, 6, 1)) for i in range(40)],
        "pub_id string, labels array<string>, create_time timestamp_ntz, modify_time timestamp_ntz")
    init_store(old, store, 8)
    new = spark.createDataFrame([("p3", ["graph"]), ("p99", [])], "pub_id string, labels array<string>")
    ts = F.lit(RUN).cast("timestamp_ntz")
    upsert_into(store, new, ts, 8)
    first = {r["pub_id"]: r for r in read_store(spark, store).collect()}
    upsert_into(store, new, ts, 8)
    second = {r["pub_id"]: r for r in read_store(spark, store).collect()}
    assert len(first) == 41 and first == second
    assert first["p3"]["labels"] == ["graph"] and first["p3"]["create_time"] == dt.datetime(2000, 1, 1)
    assert first["p3"]["modify_time"] == RUN
    assert first["p99"]["create_time"] == RUN and first["p99"]["labels"] == []
    assert first["p7"]["labels"] == ["old"] and first["p7"]["modify_time"] == dt.datetime(2000, 6, 1)


def rows(spark, store):
    return {r["pub_id"]: (tuple(r["labels"]), r["create_time"], r["modify_time"]) for r in read_store(spark, store).collect()}


def stamp(day):
    return F.lit(dt.datetime(2001, 8, day)).cast("timestamp_ntz")


def test_an_upsert_writes_what_its_batch_holds(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    many = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("pub_id"), F.array(F.md5(F.col("id").cast("string").cast("binary"))).alias("labels"),
                                      stamp(1).alias("create_time"), stamp(1).alias("modify_time"))
    init_store(many, store, 4)
    before = files.size(spark, store)
    upsert_into(store, spark.createDataFrame([("p3", ["x"]), ("new", ["y"])], "pub_id string, labels array<string>"), stamp(2), 4)
    assert files.size(spark, store) - before < 20_000 < before / 5
    got = rows(spark, store)
    assert len(got) == 20_001 and got["p3"] == (("x",), dt.datetime(2001, 8, 1), dt.datetime(2001, 8, 2))


def test_replay_crash_and_compaction(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    new = lambda *r: spark.createDataFrame(list(r), "pub_id string, labels array<string>")
    upsert_into(store, new(("a", ["1"]), ("b", ["1"])), stamp(1), 4, batch="s-0")       # a store without a base
    upsert_into(store, new(("a", ["2"])), stamp(2), 4, batch="s-1")
    want = {"a": (("2",), dt.datetime(2001, 8, 1), dt.datetime(2001, 8, 2)), "b": (("1",), dt.datetime(2001, 8, 1), dt.datetime(2001, 8, 1))}
    assert rows(spark, store) == want
    upsert_into(store, new(("a", ["late"])), stamp(3), 4, batch="s-0")                  # a replay: logged, so nothing
    assert rows(spark, store) == want
    # a crash after the files, before the log: not part of the store, written again by the replay
    new(("c", ["torn"])).withColumn("modify_time", stamp(3)).write.parquet(f"{store}/delta/name=s-2")
    many = spark.range(5).select(F.col("id").cast("string").alias("pub_id"))
    many.write.parquet(f"{store}/base/lost")
    assert rows(spark, store) == want
    upsert_into(store, new(("c", ["3"])), stamp(3), 4, batch="s-2")
    want["c"] = (("3",), dt.datetime(2001, 8, 3), dt.datetime(2001, 8, 3))
    assert rows(spark, store) == want
    compact(spark, store)
    assert rows(spark, store) == want
    upsert_into(store, new(("b", [])), stamp(4), 4, batch="s-3")
    want["b"] = ((), dt.datetime(2001, 8, 1), dt.datetime(2001, 8, 4))
    assert rows(spark, store) == want
    assert set(vacuum(spark, store)) == {"delta/name=s-0", "delta/name=s-1", "delta/name=s-2", "base/lost"}
    assert rows(spark, store) == want
    upsert_into(store, new(), stamp(5), 4, batch="s-4")                                 # an empty batch
    assert rows(spark, store) == want


def test_retention_leaves_others_alone(spark, tmp_dir):
    root = os.path.join(tmp_dir, "out")
    for n in ("2001_07_28", "2001_07_29", "2001_07_30", "2001_07_31.json", "2001_08_01", "models", "2001_13_99", "x2001_01_01"):
        spark.range(2).write.parquet(f"{root}/{n}")
    assert files.apply_retention(spark, root, dt.date(2001, 8, 1), 3) == ["2001_07_28", "2001_07_29"]
    assert files.names(spark, root) == ["2001_07_30", "2001_07_31.json", "2001_08_01", "2001_13_99", "models", "x2001_01_01"]
    assert files.apply_retention(spark, f"{root}/none", dt.date(2001, 8, 1), 3) == []
