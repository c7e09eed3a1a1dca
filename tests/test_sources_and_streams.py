import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, tables
from tidemark.streaming import streams as T


def test_csv(spark, tmp_path):
    p = tmp_path / "people.csv"
    p.write_text("﻿Name,Age,Score,Note,Ok\nAlice,30,1.5,\"a, \"\"b\"\"\nc\",True\nBob,NA,null,,False\nEve,41,nan,x,\n", encoding="utf-8")
    d = files.scan_csv(spark, str(p), row_id=True, multi_line=True)
    assert dict(d.dtypes) == {"row_id": "bigint", "Name": "string", "Age": "bigint", "Score": "double", "Note": "string", "Ok": "boolean"}
    rows = d.orderBy("row_id").collect()
    assert [r.Age for r in rows] == [30, None, 41] and [r.Score for r in rows] == [1.5, None, None]
    assert rows[0].Note == 'a, "b"\nc' and rows[1].Note is None and [r.Ok for r in rows] == [True, False, None]
    typed = files.scan_csv(spark, str(p), "Name string, Age double, Score bigint, Note string, Ok boolean", multi_line=True).collect()
    assert typed[0].Age == 30.0 and typed[0].Score is None


def test_csv_numbers_rows_in_file_order(spark, tmp_path):
    """Files of unlike size, read in many splits: Spark takes the largest first."""
    want = []
    for name, n in (("a.csv", 3), ("b.csv", 400), ("c.csv", 40)):
        rows = [f"{name}-{i}" for i in range(n)]
        (tmp_path / name).write_text("x\n" + "".join(r + "\n" for r in rows))
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        got = files.scan_csv(spark, str(tmp_path), row_id=True)
        assert got.rdd.getNumPartitions() > 3
        assert [(r.row_id, r.x) for r in got.orderBy("row_id").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n1,\n2,3\n")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "big.csv").write_text("x\n" + "1\n" * 50)
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    paths = [str(tmp_path / n) for n in ("a.csv", "b.txt", "big.csv", "folder.parquet")]
    r = {x.file.rsplit("/", 1)[-1]: x for x in files.dataset_catalog(spark, paths).collect()}
    assert len(r) == 4
    assert (r["a.csv"]["rows"], r["a.csv"].duplicates, r["a.csv"].columns, r["a.csv"].accepted) == (3, 1, "x,y", True)
    assert r["a.csv"].quality_score == pytest.approx(1 - 2 / 6 - 1 / 3, abs=1e-6) and r["a.csv"].size == 14
    assert (r["b.txt"].accepted, r["b.txt"].reason, r["b.txt"]["rows"]) == (False, "unknown extension", None)
    assert r["folder.parquet"]["rows"] == 10 and r["folder.parquet"].size > 1000
    assert r["big.csv"]["rows"] == 50
    few = {x.file.rsplit("/", 1)[-1]: x for x in files.dataset_catalog(spark, paths[:3], max_bytes=60).collect()}
    assert (few["big.csv"].accepted, few["big.csv"].reason, few["big.csv"]["rows"]) == (False, "too large", None) and few["a.csv"]["rows"] == 3
    with pytest.raises(ValueError):
        files.scan(spark, "x.xlsx")


def test_shared_folder_is_asked_for_on_a_cluster():
    from tidemark.session import shared_folder

    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    acts = spark.range(20).select(F.col("id").alias("row_id"), F.lit("skip").alias("action_type"), F.lit("id").alias("column"),
                                  F.lit(None).cast("string").alias("old_value"), F.lit("x").alias("new_value"), F.lit(0.1).alias("reward"))
    for job in ("j1", "j2"):
        tables.append_audit(tables.audit_rows(acts, job, F.lit("2024-01-01").cast("timestamp")), path)
    assert tables.read_audit(spark, path).count() == 40
    one = tables.read_audit(spark, path, "j2")
    assert one.count() == 20 and set(one.columns) == set(tables.AUDIT_COLUMNS)


def events(spark, path, rows):
    spark.createDataFrame(rows, "id long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(path)


def at(minute):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_dedupe_drops_late_rows_and_copies(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    events(spark, src, [(1, at(0), 1.0), (1, at(1), 1.0), (2, at(60), 2.0)])

    def run():
        s = spark.readStream.schema("id long, ts timestamp, v double").parquet(src)
        return T.run_available(T.stream_dedupe(s, ["id"], "ts", "10 minutes"), out, state)

    assert sorted(r.id for r in run().collect()) == [1, 2]
    events(spark, src, [(3, at(2), 3.0), (2, at(61), 2.0), (4, at(65), 4.0)])  # too late, a copy, new
    assert sorted(r.id for r in run().collect()) == [1, 2, 4]


def test_agent_history_over_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "agent string, row_id long, reward double"
    for batch in range(3):
        rows = [("hot" if i % 3 else "cold", batch * 200 + i, float(batch)) for i in range(200)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = T.stream_agent_history(spark.readStream.schema(schema).parquet(src), out, state)
        q.awaitTermination()
        assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"v{b}" for b in range(max(0, batch - 1), batch + 1)]
    got = {r.agent: (r.reward_avg, r.kept) for r in T.snapshot_averages(spark, out, 2).collect()}
    assert got["hot"] == (2.0, 100) and got["cold"][1] == 100 and 1.0 < got["cold"][0] < 2.0


def test_scratch_goes_with_its_block(spark, tmp_path, monkeypatch):
    from tidemark import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    outer = session.cut(spark.range(3), "outer")
    with session.scratch(spark):
        inner = session.cut(outer, "inner")
        with session.scratch(spark):
            session.cut(inner, "innermost")
            assert len(list(tmp_path.iterdir())) == 3
        assert inner.count() == 3
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["outer"] and outer.count() == 3


def test_stream_audit_repeats_nothing(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    events(spark, src, [(i, at(i), 0.0) for i in range(5)])
    for _ in range(2):
        s = spark.readStream.schema("id long, ts timestamp, v double").parquet(src)
        T.stream_audit(s, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 5
