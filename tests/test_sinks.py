"""The log of steps, plans read by place, sketches of lengths, and the collate table function."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from paceline import consumer
from paceline.operators import profile
from paceline.sources import placed, steplog

SCHEMA = "rank int, step long, ids array<long>"


def _steps(spark, ranks, n, begin=0):
    rows = [(r, k, [k, k + 1] if k % 7 else None) for r in ranks for k in range(begin, begin + n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def _read(spark, path):
    return sorted((str(r.rank), r.step, r.ids or []) for r in steplog.read_steps(spark, path, SCHEMA).collect())


def _same(df):
    return sorted((str(r.rank), r.step, r.ids or []) for r in df.collect())


def test_a_run_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = _steps(spark, [0, 1, None], 50)
    for _ in range(3):
        steplog.log_steps(rows, path, "first")
    assert _read(spark, path) == _same(rows)
    assert steplog.sweep(path, 0) == 0
    more = _steps(spark, [0], 5, 50)
    steplog.log_steps(more, path)
    assert _read(spark, path) == sorted(_same(rows) + _same(more))
    steplog.log_steps(rows.limit(0), path, "none")
    assert len(_read(spark, path)) == 155
    with pytest.raises(Exception, match="need a column rank"):
        steplog.log_steps(rows.drop("rank"), path, order=("step",))


def test_failed_tasks_leave_no_steps(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = _steps(spark, range(4), 40)
    steplog.log_steps(rows, path, "good")
    # fails in the last range, when other tasks have written whole files
    bad = rows.withColumn("step", F.when((F.col("rank") == 3) & (F.col("step") == 39), F.raise_error(F.lit("lost"))).otherwise(F.col("step")))
    spark.dataSource.register(steplog.StepLog)
    ready = bad.repartition(4, "rank")
    with pytest.raises(Exception, match="lost"):
        ready.write.format(steplog.NAME).mode("append").option("path", path).option("run", "bad").save()
    assert _read(spark, path) == _same(rows)
    steplog.sweep(path, 0)
    assert _read(spark, path) == _same(rows)


def test_more_ranks_than_open_files(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = _steps(spark, range(steplog.OPEN + 9), 3).coalesce(1)
    spark.dataSource.register(steplog.StepLog)
    rows.write.format(steplog.NAME).mode("append").option("path", path).save()
    assert _read(spark, path) == _same(rows)


def test_a_stream_that_starts_again_writes_steps_once(spark, tmp_path):
    source, path, mark = tmp_path / "in", f"file://{tmp_path}/log", tmp_path / "mark"
    parts = [_steps(spark, [0, 1], 10, 10 * k) for k in range(3)]

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        steplog.stream_steps(rows, path, str(mark), availableNow=True).awaitTermination()

    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(str(source))
    run()
    want = sorted(_same(parts[0]) + _same(parts[1]))
    assert _read(spark, path) == want
    # the driver dies between the manifest and Spark's own note of the batch: the batch comes again
    last = max(glob.glob(f"{mark}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for f in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(f):
            os.remove(f)
    parts[2].coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert os.path.exists(last)
    assert _read(spark, path) == sorted(want + _same(parts[2]))


def test_a_placed_plan_is_read_from_its_middle(spark, tmp_path):
    rows = _steps(spark, [0, 1, 2], 500)
    path = f"file://{tmp_path}/plan"
    placed.place(rows, path, per_file=100)
    whole = [r.step for r in placed.open_at(spark, path, 1)]
    assert whole == list(range(500))
    for step in (0, 1, 250, 499, 500):
        assert [r.step for r in placed.open_at(spark, path, 1, step)] == whole[step:]
        assert placed.rows_from(spark, path, 1, step).count() == 500 - step
    every, late = placed.index_from(spark, path, 1), placed.index_from(spark, path, 1, 400)
    assert sum(f["n"] for f in every) == 500 and 0 < len(late) < len(every)
    assert list(placed.open_at(spark, path, 9)) == []
    placed.place(rows.limit(0), path + "-empty")
    assert list(placed.open_at(spark, path + "-empty", 0)) == []


def test_sketches_merge_within_their_error(spark):
    d = spark.range(60_000).select((F.col("id") % 3).cast("int").alias("rank"), F.floor(F.col("id") / 900).alias("round"), F.floor(F.exp(F.rand(3) * 8)).cast("long").alias("length"))
    d = d.withColumn("length", F.when(F.col("rank") < 2, F.col("length"))).cache()
    rounds = profile.length_sketches(d)
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    per = {r["rank"]: r for r in profile.merged(rounds).select("rank", "n", *(profile.quantile(p).alias(str(p)) for p in shares), profile.variation().alias("cv")).collect()}
    assert per[2]["n"] == 0 and per[2]["0.5"] is None and per[2]["cv"] is None
    for rank in (0, 1):
        values = sorted(r.length for r in d.filter(F.col("rank") == rank).collect())
        for p in shares:
            got = per[rank][str(p)]
            below, upto = (sum(v < got for v in values) / len(values), sum(v <= got for v in values) / len(values))
            assert below - profile.RANK_ERROR <= p <= upto + profile.RANK_ERROR
        mean = sum(values) / len(values)
        assert abs(per[rank]["cv"] - (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / mean) < 1e-9
    assert profile.merged(profile.length_sketches(d.limit(0))).count() == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from paceline.sources import workdir

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}

    old, kept = shuffled(), spark.conf.get(workdir.CLEANUP)
    d = workdir.stored(spark.range(10_000).repartition(7, "id").withColumn("k", F.col("id") % 10))
    until = time.time() + 5
    while shuffled() - old and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - old and spark.conf.get(workdir.CLEANUP) == kept
    assert d.groupBy("k").count().filter("count = 1000").count() == 10


def test_quantiles_of_many_rows_are_exact(spark, tmp_path):
    from __spark_entry__ import oracle_sql, queries
    import duckdb

    rng = random.Random(8)
    docs = [(i, " ".join("w" * rng.randint(1, 3000)) if i % 50 else None, "en", "web", 0) for i in range(20_400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries()["length_profile"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(oracle_sql()["length_profile"]).fetchall()) and got[0][1] > profile.K
    few = spark.createDataFrame([(0, x) for x in (5, 5, 1, None, 9)] + [(1, None), (None, 3)], "rank int, length long")
    got = {r[0]: tuple(r)[1:] for r in profile.exact(few, {"low": 0.25, "middle": 0.5, "all": 1.0}).drop("squares").collect()}
    assert got == {0: (4, 20, 1, 9, 1, 5, 9), 1: (0, 0, None, None, None, None, None), None: (1, 3, 3, 3, 3, 3, 3)}
    assert profile.exact(few.limit(0), {"middle": 0.5}).count() == 0


def test_collate_table_function(spark):
    rows = spark.createDataFrame([(g, k, f"{g}{k}" if k else None) for g in range(5) for k in range(g)], "g long, k long, t string")
    consumer.collate_table(spark, "joined", lambda: [], lambda s, r: [*s, r["t"]], lambda s: ("|".join(x or "-" for x in s),) if len(s) > 1 else None, "t string")
    got = spark.sql("SELECT t FROM joined(TABLE(SELECT * FROM {rows}) PARTITION BY g ORDER BY k DESC)", rows=rows).collect()
    assert sorted(r.t for r in got) == ["21|-", "32|31|-", "43|42|41|-"]
    assert spark.sql("SELECT t FROM joined(TABLE(SELECT * FROM {rows}) PARTITION BY g ORDER BY k)", rows=rows.limit(0)).count() == 0
