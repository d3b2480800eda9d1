"""Reading and writing."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch import operators as O
from tidewatch.session import shared_folder, stage
from tidewatch.sources import (
    commit_snapshot,
    dimension,
    dimension_names,
    latest_snapshot_date,
    normalize_columns,
    prune,
    publish,
    read_extract,
    read_published,
    read_snapshot,
    refresh_copies,
    snapshot_dates,
    with_input_order,
    write_by_recipient,
    write_extract,
)
from tidewatch.sources import commits, sinks
from tidewatch.sources.dimensions import dimension_table

D = dt.date


def test_extract_blank_na_and_quoted(spark, rows, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('"",Week.Of,First Name,n\n1,2021-08-22,,5\n2,NA,"",NA\n3,x,Ann,7\n')
    df = read_extract(spark, str(path), drop_first=True)
    assert df.columns == ["week_of", "first_name", "n"]
    filled = O.fill_blank(O.parse_dates(df, ["week_of"]), ["first_name"])
    assert rows(filled, "week_of", "first_name", "n") == [
        (None, "", None),
        (None, "Ann", "7"),
        (D(2021, 8, 22), "", "5"),
    ]


def test_extract_positional_schema(spark, rows, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("row,Date,School,New Cases\n1,2021-08-22,A,5\n2,2021-08-23,B,NA\n")
    df = read_extract(
        spark, str(path), "row INT, date DATE, school STRING, new_cases DOUBLE", drop_first=True
    )
    assert rows(df) == [(D(2021, 8, 22), "A", 5.0), (D(2021, 8, 23), "B", None)]


def test_colliding_names_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `a b` int")
    with pytest.raises(ValueError, match="collide"):
        normalize_columns(df)


def test_input_order_keeps_the_first_line(spark, rows, tmp_path):
    """Many small splits, read in any order, still give each key its first line."""
    lines = [f"{i % 7},{i}" for i in range(5000)]
    (tmp_path / "a.csv").write_text("k,v\n" + "\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.csv").write_text("k,v\n" + "\n".join(lines[2500:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_extract(spark, str(tmp_path), input_order=True)
        assert df.rdd.getNumPartitions() > 4
        first = O.distinct_on(df, "k", ["input_order"]).withColumn("v", F.col("v").cast("int"))
        assert sorted(v for _, v in rows(first, "k", "v")) == list(range(7))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_input_order_on_parquet(spark, rows, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS v").coalesce(1).write.parquet(
        str(tmp_path / "t")
    )
    df = with_input_order(spark.read.parquet(str(tmp_path / "t")))
    assert rows(O.distinct_on(df, "k", ["input_order"]), "k", "v") == [(0, 0), (1, 1), (2, 2)]


def test_write_extract_reads_back(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, None)], "t string, n int")
    write_extract(df, str(tmp_path / "out"))
    assert rows(read_extract(spark, str(tmp_path / "out"))) == [(None, None), ("a", "1")]


def test_snapshots_roll_forward(spark, rows, tmp_path):
    path = str(tmp_path / "snap")
    for day, n in (("2021-09-01", 1), ("2021-09-02", 2), ("2021-09-02", 3)):
        commit_snapshot(spark.createDataFrame([(n,)], "n int"), path, day)
    assert rows(read_snapshot(spark, path, "2021-09-02")) == [(1,)]
    assert rows(read_snapshot(spark, path, "2021-09-03")) == [(3,)]
    assert rows(read_snapshot(spark, path, "2021-09-01")) == []
    assert latest_snapshot_date(spark, path, "2021-09-03") == D(2021, 9, 2)


def test_recipients_get_their_own_folder(spark, tmp_path):
    df = spark.range(90).selectExpr("if(id < 60, 'big', concat('s', id % 3)) AS recipient", "id")
    write_by_recipient(df, str(tmp_path / "lists"))
    folders = sorted(p.name for p in Path(tmp_path / "lists").glob("recipient=*"))
    assert folders == ["recipient=big", "recipient=s0", "recipient=s1", "recipient=s2"]
    back = spark.read.option("header", True).csv(str(tmp_path / "lists"))
    assert back.count() == 90


def test_publish_keeps_languages_apart(spark, rows, tmp_path):
    base = str(tmp_path / "pub")
    publish({"t": spark.createDataFrame([("en",)], "x string")}, base, "2021-09-01", "en")
    publish({"t": spark.createDataFrame([("es",)], "x string")}, base, "2021-09-01", "es")
    publish({"t": spark.createDataFrame([("en2",)], "x string")}, base, "2021-09-02", "en")
    assert rows(spark.read.parquet(f"{base}/en/latest/t")) == [("en2",)]
    assert rows(spark.read.parquet(f"{base}/en/as_of=2021-09-01/t")) == [("en",)]
    assert rows(spark.read.parquet(f"{base}/es/latest/t")) == [("es",)]


def test_dimensions(spark):
    sizes = {n: dimension(spark, n).count() for n in dimension_names()}
    assert sizes["school"] == 67
    assert sizes["school_alias"] == 62
    assert sizes["recipient"] == 16
    assert sizes["school_district"] == 5
    with pytest.raises(KeyError):
        dimension(spark, "nowhere")


@pytest.mark.parametrize(
    "name, key",
    [
        ("county", ["code"]),
        ("population", ["region"]),
        ("coverage_population", ["region", "band"]),
        ("coverage_band", ["kind", "value"]),
        ("city_population", ["city"]),
        ("school", ["school"]),
        ("school_alias", ["place_name"]),
        ("school_district", ["district"]),
        ("exposure_district", ["exposure_district"]),
        ("recipient", ["kind", "value"]),
        ("labels", ["key", "lang"]),
    ],
)
def test_dimension_keys_are_unique(name, key):
    listed = [tuple(r[k] for k in key) for r in dimension_table(name).to_pylist()]
    assert len(set(listed)) == len(listed)


def test_dimensions_refer_to_each_other():
    schools = {r["school"] for r in dimension_table("school").to_pylist()}
    districts = {r["district"] for r in dimension_table("school_district").to_pylist()}
    assert {r["school"] for r in dimension_table("school_alias").to_pylist()} <= schools
    assert {r["district"] for r in dimension_table("school").to_pylist()} == districts
    assert {r["district"] for r in dimension_table("exposure_district").to_pylist()} == districts
    for r in dimension_table("recipient").to_pylist():
        assert r["value"] in (districts if r["kind"] == "district" else schools)
    labels = dimension_table("labels").to_pylist()
    assert {r["key"] for r in labels if r["lang"] == "en"} == {
        r["key"] for r in labels if r["lang"] == "es"
    }


def test_stage_uses_the_named_folder(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, None)], "n int, t string")
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert shared_folder(spark, "elsewhere") == str(folder)
    before = set(folder.glob("staged-*"))
    assert rows(stage(df, str(tmp_path / "unused"))) == [(1, None)]
    assert len(set(folder.glob("staged-*")) - before) == 1
    assert not (tmp_path / "unused").exists()


def test_quotes_and_line_breaks_as_the_extracts_have_them(spark, rows, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('"","id","details"\n"1",1,"bus ""12"" route, A"\n"2",2,"two\nlines"\n"3",3,NA\n"4",4,"a\\b"\n')
    df = read_extract(spark, str(path), drop_first=True, multi_line=True)
    assert rows(df, "id", "details") == [("1", 'bus "12" route, A'), ("2", "two\nlines"), ("3", None), ("4", "a\\b")]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_extract(spark, str(path), drop_first=True).collect()
    write_extract(df, str(tmp_path / "again"))
    assert rows(read_extract(spark, str(tmp_path / "again"), multi_line=True)) == rows(df)
    assert '"bus ""12"" route, A"' in "".join(p.read_text() for p in (tmp_path / "again").glob("*.csv"))


def test_values_a_type_cannot_hold_are_null(spark, rows, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("d,n\n2021-08-22,5\nsoon,many\n")
    assert rows(read_extract(spark, str(path), "d DATE, n INT")) == [(None, None), (D(2021, 8, 22), 5)]


def test_snapshots_without_rows_and_the_first_run(spark, rows, tmp_path):
    path, some = str(tmp_path / "snap"), spark.createDataFrame([(1,), (2,)], "n int")
    with pytest.raises(ValueError, match="first run"):
        read_snapshot(spark, path, "2021-01-01")
    assert rows(read_snapshot(spark, path, "2021-01-01", "n int")) == []
    commit_snapshot(some, path, "2021-01-01")
    commit_snapshot(some, path, "2021-01-02")
    commit_snapshot(some.limit(0), path, "2021-01-02")
    assert rows(read_snapshot(spark, path, "2021-01-03")) == []
    assert rows(read_snapshot(spark, path, "2021-01-02")) == [(1,), (2,)]
    assert read_snapshot(spark, path, "2021-01-01").columns == ["n"]


def test_a_rerun_leaves_no_old_recipient(spark, tmp_path):
    path = str(tmp_path / "lists")
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "recipient string, n int")
    write_by_recipient(df, path)
    write_by_recipient(df.filter("recipient = 'r1'"), path, recipients=["r1", "r2", "r 3"])
    found = {p.name: "".join(f.read_text() for f in p.glob("*.csv")) for p in Path(path).glob("recipient=*")}
    assert sorted(found.values()) == ["n\n", "n\n", "n\n1\n"] and found["recipient=r1"] == "n\n1\n"


def test_latest_is_swapped_at_once_and_sorted(spark, rows, tmp_path):
    base = str(tmp_path / "pub")
    publish({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}, base, "2021-09-01")
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        publish({"a": spark.range(9).toDF("x"), "b": broken}, base, "2021-09-02")
    assert spark.read.parquet(f"{base}/en/latest/a").count() == 3
    publish({"a": spark.createDataFrame([(3,), (1,), (2,)], "x int")}, base, "2021-09-03", order={"a": ["x"]})
    assert [r.x for r in spark.read.parquet(f"{base}/en/latest/a").collect()] == [1, 2, 3]
    assert spark.read.parquet(f"{base}/en/latest/b").count() == 2


def test_a_bundle_is_whole_whenever_the_run_dies(spark, rows, tmp_path, monkeypatch):
    """Before the commit readers see the old bundle, after it the new one."""
    base = str(tmp_path / "pub")
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    seen = lambda name: rows(read_published(spark, base, name))
    publish({"a": frame(1), "b": frame(1), "c": frame(1)}, base, "2021-09-01")
    for step, holds in (("commit", 1), ("refresh", 2)):
        with monkeypatch.context() as m:
            def die(*args):
                raise RuntimeError("killed")

            if step == "commit":
                m.setattr(sinks.commits, "commit", die)
            else:
                m.setattr(sinks, "_swap", die)
            with pytest.raises(RuntimeError, match="killed"):
                publish({"a": frame(2), "b": frame(2)}, base, "2021-09-02")
        assert seen("a") == seen("b") == [(holds,)] and seen("c") == [(1,)]
    assert rows(spark.read.parquet(f"{base}/en/latest/a")) == [(1,)]
    refresh_copies(spark, base)
    assert rows(spark.read.parquet(f"{base}/en/latest/a")) == [(2,)]
    assert rows(spark.read.parquet(f"{base}/en/latest/c")) == [(1,)]
    assert rows(spark.read.parquet(f"{base}/en/as_of=2021-09-02/b")) == [(2,)]
    with pytest.raises(ValueError, match="no table"):
        read_published(spark, base, "d")


def test_pruning_keeps_what_is_named(spark, rows, tmp_path):
    base = str(tmp_path / "pub")
    for n in range(5):
        tables = {"a": spark.createDataFrame([(n,)], "x int")}
        publish(tables if n else {**tables, "b": tables["a"]}, base, f"2021-09-0{n + 1}")
    gone = prune(spark, f"{base}/en", keep=2)
    assert len(gone) == 3 and len(list(Path(base, "en", "data").glob("*/*"))) == 3
    assert rows(read_published(spark, base, "a")) == [(4,)] and rows(read_published(spark, base, "b")) == [(0,)]
    assert prune(spark, f"{base}/en", keep=2) == []


def test_two_runs_cannot_commit_the_same_version(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "log")
    assert commits.current(spark, base) == {}
    assert commits.commit(spark, base, {"n": 1}) == 1
    monkeypatch.setattr(commits, "_numbers", lambda *a: [])  # a run that looked before the other's commit
    with pytest.raises(OSError, match="another run"):
        commits.commit(spark, base, {"n": 2})
    monkeypatch.undo()
    assert commits.current(spark, base) == {"n": 1}


def test_a_snapshot_that_dies_keeps_what_the_day_had(spark, rows, tmp_path, monkeypatch):
    path, some = str(tmp_path / "snap"), spark.createDataFrame([(1,)], "n int")
    some.write.parquet(f"{path}/snapshot_date=2020-12-31")  # from elsewhere
    commit_snapshot(some.selectExpr("n + 1 AS n"), path, "2021-01-01")
    with monkeypatch.context() as m:
        m.setattr(sinks.commits, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            commit_snapshot(some.selectExpr("n + 9 AS n"), path, "2021-01-01")
    assert rows(read_snapshot(spark, path, "2021-01-02")) == [(2,)]
    assert rows(read_snapshot(spark, path, "2021-01-01")) == [(1,)]
    assert [str(d) for d in snapshot_dates(spark, path)] == ["2020-12-31", "2021-01-01"]


def test_a_drill_down_touches_few_files(spark, tmp_path):
    """Published by entity and date, a table is read in one file for one entity."""
    base = str(tmp_path / "pub")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 4000, 1, 4).selectExpr("id * 7919 % 40 AS school", "id DIV 40 AS date")
        publish({"t": df}, base, "2021-09-01", order={"t": ["school", "date"]})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    t = read_published(spark, base, "t")
    assert len(t.inputFiles()) > 2
    one = t.filter("school = 3").select("_metadata.file_name").distinct().count()
    assert one <= 2
    bounds = t.groupBy("_metadata.file_name").agg(F.min("school").alias("lo"), F.max("school").alias("hi")).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:]))  # noqa: B905


def test_a_cluster_has_to_name_its_shared_folder():
    class Session:
        """A session on a cluster that names no folder."""

        conf = sparkContext = None

        def __init__(self, **named):
            self.conf = self
            self.sparkContext = self
            self.master, self.named = "spark://host:7077", named

        def getConf(self):
            return self

        def get(self, key, default=None):
            return self.named.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(**{"spark.sql.warehouse.dir": "spark-warehouse"}))
    assert shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_folder(Session(), "hdfs://z") == "hdfs://z"
