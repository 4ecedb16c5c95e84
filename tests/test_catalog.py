"""Results, states of jobs and stored objects."""

import threading

from pyspark.sql import functions as F

from rallyframe.plans import catalog

KIND = "id string, status string, progress int, error_message string"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def result(spark, ids, value=1):
    return spark.createDataFrame([(int(i), value) for i in ids], "match_id long, v int")


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/stats"
    writers = [threading.Thread(target=lambda k=k: [catalog.save_stats(result(spark, range(10 * k + n, 10 * k + n + 3), k), path) for n in range(3)]) for k in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert rows(catalog.load_stats(spark, path), "match_id", "v") == sorted([(10 * k + n, k) for k in (1, 2) for n in range(5)], key=str)


def test_compaction_keeps_the_newest_and_what_is_added_meanwhile(spark, tmp_path):
    path = f"file://{tmp_path}/stats"
    for value in (1, 2, 3):
        catalog.save_stats(result(spark, [7, 8], value), path)
    catalog.compact_stats(spark, path)
    assert spark.read.parquet(path).count() == 2
    catalog.save_stats(result(spark, [8], 9).withColumn("later", F.lit("x")), path)
    want = [(7, 3, None), (8, 9, "x")]
    assert rows(catalog.load_stats(spark, path), "match_id", "v", "later") == want
    catalog.compact_stats(spark, path)
    assert rows(catalog.load_stats(spark, path, "match_id long, v int, later string"), "match_id", "v", "later") == want


def test_a_lookup_reads_few_rows(spark, tmp_path):
    path = f"file://{tmp_path}/stats"
    ids = spark.range(0, 400_000, 2).selectExpr("id as match_id", "cast(id % 9 as int) as v")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "100000")
    try:
        catalog.save_stats(ids.repartition(2), path)
    finally:
        conf.unset("parquet.block.size")
    for match_id, want in ((200_000, [(200_000, 2)]), (200_001, [])):
        df = catalog.load_stats(spark, path, "match_id long, v int", match_id)
        assert rows(df, "match_id", "v") == want
        scan = spark.read.schema("match_id long, v int").parquet(path).where(F.col("match_id") == match_id)
        scan.collect()
        leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert leaf.metrics().apply("numOutputRows").value() < 60_000


def jobs(spark, *states):
    return spark.createDataFrame([(str(i), s, 0, None) for i, s in enumerate(states)], KIND)


def test_a_failing_match_fails_alone(spark, tmp_path):
    states, path = f"file://{tmp_path}/states", f"file://{tmp_path}/stats"

    def analysis(begun):
        assert sorted(r.status for r in catalog.load_states(spark, states).collect()) == ["processing"] * 3
        return begun.where("id <> '2'").selectExpr("match_id", "1 as v"), spark.createDataFrame([("1", "y" * 3000)], "id string, message string")

    got = {r.id: r for r in catalog.run_jobs(jobs(spark, "queued", "queued", "queued", "completed"), analysis, path, states).collect()}
    assert [got[i].status for i in "0123"] == ["completed", "failed", "failed", "completed"]
    assert (got["0"].progress, got["1"].progress, len(got["1"].error_message), got["2"].error_message) == (100, 0, 1000, "no tracks for match 2")
    assert rows(catalog.load_stats(spark, path), "match_id") == [(0,)]
    told = [(r.id, r.status, r.progress) for r in catalog.load_states(spark, states).orderBy("at").collect()]
    assert [t for t in told if t[0] == "0"] == [("0", "processing", 0), ("0", "processing", 90), ("0", "completed", 100)]


def test_a_second_attempt(spark, tmp_path):
    states, path = f"file://{tmp_path}/states", f"file://{tmp_path}/stats"
    fails = lambda begun: begun.where("false").selectExpr("match_id", "1 as v")
    works = lambda begun: begun.selectExpr("match_id", "2 as v")
    assert catalog.run_jobs(jobs(spark, "queued"), fails, path, states).first().status == "failed"
    assert catalog.run_jobs(jobs(spark, "queued"), works, path, states).first().status == "completed"
    assert rows(catalog.current_states(spark, states), "id", "status", "progress") == [("0", "completed", 100)]


def test_runs_at_the_same_time_share_the_matches(spark, tmp_path):
    states = f"file://{tmp_path}/states"
    queued, won = jobs(spark, *["queued"] * 8), {}
    runs = [threading.Thread(target=lambda k=k: won.update({k: {r.id for r in catalog.claim(queued, states, f"run{k}").collect()}})) for k in range(3)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    owner = {r.id: r.run for r in catalog._owners(catalog.load_states(spark, states)).collect()}
    assert set(owner) == {str(i) for i in range(8)}
    assert all(i in won[int(run[3:])] for i, run in owner.items())
    assert catalog.claim(queued, states, "late").count() == 0


def test_orphaned_objects_go(spark, tmp_path):
    for name in ("videos/1.mp4", "videos/2.mp4", "crops/1/0.jpg", "crops/3/0.jpg", "crops/3/1.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 9)
    matches = spark.createDataFrame([("1",), ("9",)], "id string")
    objects = catalog.stored_objects(spark, f"file://{tmp_path}")
    found = catalog.orphans(objects, matches)
    assert rows(found, "of", "length") == [("2", 9), ("3", 9), ("3", 9)]
    assert all(r.deleted for r in catalog.delete_objects(found).collect())
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.*")) == ["crops/1/0.jpg", "videos/1.mp4"]
    assert catalog.orphans(catalog.stored_objects(spark, f"file://{tmp_path}"), matches).isEmpty()
