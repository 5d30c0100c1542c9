import pytest
from pyspark.sql import functions as F

from tidegauge.operators.joins import merge_sensors
from tidegauge.plans.sensors import folder_features
from tidegauge.sources import files, tsf

HEAD = """# comment
@relation demo
@attribute series_name string
@attribute region numeric
@attribute start_timestamp date
@frequency daily
@horizon 7
@missing true
@equallength false
@data
"""


def write(tmp_path, text, name="demo.tsf"):
    p = tmp_path / name
    p.write_bytes(text.encode("cp1252"))
    return str(p)


def test_tsf(spark, tmp_path):
    path = write(tmp_path, HEAD + "Zürich – 1:3:2001-02-03 04-05-06:1,2.5,?,4\n\n  B:-4:2002-01-01 00-00-00:?,7  \n")
    t = tsf.read_tsf(spark, path)
    rows = t.orderBy("ordinal").collect()
    assert [r.dataset for r in rows] == ["demo", "demo"] and [r.ordinal for r in rows] == [0, 1]
    a, b = rows
    assert a.attrs["series_name"] == "Zürich – 1" and a.series_value == [1.0, 2.5, None, 4.0]
    assert (a.freq, a.horizon, a.has_missing, a.equal_length) == ("daily", 7, True, False)
    assert b.series_value == [None, 7.0]
    assert sorted(r[0] for r in t.select(tsf.numeric_attr("region")).collect()) == [-4, 3]
    assert str(t.filter("ordinal = 0").select(tsf.date_attr("start_timestamp")).first()[0]) == "2001-02-03 04:05:06"
    long = files.reader("monash")(spark, path).orderBy("series_id", "idx").collect()
    assert [(r.series_id, r.idx, r.y) for r in long] == [("T1", 0, 1.0), ("T1", 1, 2.5), ("T1", 2, 4.0), ("T2", 0, 7.0)]


@pytest.mark.parametrize("text,message", [
    ("", "no content"),
    ("# only a comment\n", "no content"),
    ("@relation x\n@data\nA:1\n", "attribute"),
    ("@attribute a string\nA:1,2\n", "before any data mark"),
    ("@attribute a\n@data\nA:1\n", "header line"),
    ("@attribute a string\n@frequency daily extra\n@data\nA:1\n", "header line"),
    ("@attribute a string\n@data\n", "no series line"),
    ("@data\n@attribute a string\nA:1\n", "attribute"),
])
def test_tsf_file_errors(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        tsf.read_tsf(spark, write(tmp_path, text))


@pytest.mark.parametrize("line,message", [
    ("A:3:1,2", "wrong number of fields"),
    ("A:3:2001-02-03 04-05-06:?,?", "only missing values"),
    ("A:x:2001-02-03 04-05-06:1", "does not suit its type"),
    ("A:3:yesterday:1", "does not suit its type"),
])
def test_tsf_line_errors(spark, tmp_path, line, message):
    t = tsf.read_tsf(spark, write(tmp_path, HEAD + line + "\n"))
    with pytest.raises(Exception, match=message):
        t.collect()


def test_tsf_unknown_attribute_type(spark, tmp_path):
    t = tsf.read_tsf(spark, write(tmp_path, "@attribute a blob\n@data\nA:1,2\n"))
    with pytest.raises(Exception, match="unknown type"):
        t.collect()


def test_tsf_lenient(spark, tmp_path):
    text = HEAD + "A:3:2001-02-03 04-05-06:1,2\nbroken:1\nB:4:2001-02-03 04-05-06:3\n"
    good, bad = tsf.read_tsf(spark, write(tmp_path, text), mode="lenient")
    assert [r.series_value for r in good.orderBy("ordinal").collect()] == [[1.0, 2.0], [3.0]]
    assert [r.line for r in bad.collect()] == ["broken:1"]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "ETTh1.csv").write_text("date,a/b,c\n2020-01-01 00:00:00,1,2.5\n2020-01-01 01:00:00,,3\n")
    (tmp_path / "one.csv").write_text("when,z\n2020-01-01,7\n")
    s = files.read_wide_csv(spark, [str(tmp_path / "ETTh1.csv"), str(tmp_path / "one.csv")])
    got = [(r.dataset, r.series_id, r.idx, str(r.ts), r.y) for r in s.orderBy("dataset", "series_id", "idx").collect()]
    assert got == [
        ("ETTh1", "a/b", 0, "2020-01-01 00:00:00", 1.0), ("ETTh1", "a/b", 1, "2020-01-01 01:00:00", None),
        ("ETTh1", "c", 0, "2020-01-01 00:00:00", 2.5), ("ETTh1", "c", 1, "2020-01-01 01:00:00", 3.0),
        ("one", "z", 0, "2020-01-01 00:00:00", 7.0),
    ]


def test_csv_scan_reads_only_the_target(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,a,OT\n2020-01-01,1,2\n")
    s = files.select_series(files.read_wide_csv(spark, str(tmp_path / "w.csv"), only=["OT"]), "S", "OT")
    assert [r.y for r in s.collect()] == [2.0]
    assert "ReadSchema: struct<date:string,OT:string>" in s._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        files.select_series(s, "X")


def test_series_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n,3\n4,5\n")
    spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double").coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    s = files.read_series_list(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.parquet")])
    got = [(r.dataset, r.series_id, r.idx, r.y) for r in s.orderBy("dataset", "series_id", "idx").collect()]
    assert got == [("a", "x", 0, 1.0), ("a", "x", 1, 4.0), ("a", "y", 0, 2.0), ("a", "y", 1, 5.0), ("b", "x", 0, 1.0), ("b", "x", 1, 3.0)]
    with pytest.raises(ValueError):
        files.read_series_list(spark, "x.feather")


def test_series_list_of_many_splits_sorts_no_rows(spark, tmp_path):
    """Long series over several files and splits, two paths of one dataset: places follow the files, without a sort of the rows."""
    rows = [(float(i), float(i % 7) if i % 5 else None) for i in range(2000)]
    for folder, part in (("one", rows[:1500]), ("two", rows[1500:])):
        df = spark.createDataFrame(part, "p double, q double").repartitionByRange(6, "p").sortWithinPartitions("p")
        df.write.parquet(str(tmp_path / folder / "s.parquet"))
    spark.conf.set("spark.tidegauge.maxGroupRows", "100")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        s = files.read_series_list(spark, [str(tmp_path / "one" / "s.parquet"), str(tmp_path / "two" / "s.parquet")])
        got = sorted((r.series_id, r.idx, r.y) for r in s.collect())
        plan = s._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.tidegauge.maxGroupRows")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [r for r in rows if r[1] is not None]
    assert got == [("p", i, r[0]) for i, r in enumerate(kept)] + [("q", i, r[1]) for i, r in enumerate(kept)]
    assert "Sort" not in plan and "Repartition" not in plan and "LogicalRDD" not in plan


def recordings(root):
    for rec, start in (("r1", 0), ("r2/inner", 5)):
        d = root / rec
        d.mkdir(parents=True)
        for sensor in ("Acc", "Gyro"):
            (d / f"{sensor}.txt").write_text("\n".join(f"{start + i},{i % 5},{i * i % 7}" for i in range(60)))
        (d / "notes.txt").write_text("time,remark\n1,hello\n")


def test_sensor_folders(spark, tmp_path):
    recordings(tmp_path)
    s = files.read_sensor_folders(spark, str(tmp_path))
    assert {r.sensor for r in s.select("sensor").distinct().collect()} == {"Acc", "Gyro"}
    assert s.count() == 2 * 2 * 2 * 60
    assert files.read_sensor_folders(spark, str(tmp_path), ["Acc.txt"]).count() == 2 * 2 * 60
    (tmp_path / "r3").mkdir()
    (tmp_path / "r3" / "Wide.csv").write_text("\n".join(",".join(str(i * 100 + a) for a in range(41)) for i in range(3)))
    wide = files.read_sensor_folders(spark, str(tmp_path), ["Wide.csv"])
    assert {(r.axis, r.v - r.t) for r in wide.collect()} == {(a, float(a)) for a in range(1, 41)} and wide.count() == 120


def test_samples_of_one_time_keep_their_order(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "A.csv").write_text("\n".join(f"{i // 2},{(i * 7) % 5}" for i in range(20)))
    got = [sorted(map(tuple, merge_sensors(files.read_sensor_folders(spark, str(tmp_path)).repartition(k), 1.0, 1.0).collect())) for k in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 9


def test_rejected_cells(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,a,b\n2020-01-01,1,x\n2020-01-02,-,\n2020-01-03,-,x2\n2020-01-04,1e3,x\n")
    got = {tuple(r) for r in files.rejected_cells(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {("d", "a", "-", 2), ("d", "b", "x", 2), ("d", "b", "x2", 1)}


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_tsf_ordinals_over_many_blocks(spark, tmp_path, mode):
    for name in ("one", "two"):
        lines = [f"T{i}:{i}:2001-02-03 04-05-06:{i},{i + 1}" + (":odd" if mode == "lenient" and i % 7 == 2 else "") for i in range(400)]
        (tmp_path / f"{name}.tsf").write_text(HEAD + "\n# remark\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = tsf.read_tsf(spark, [str(tmp_path / f"{n}.tsf") for n in ("one", "two")], mode)
        kept = out[0] if mode == "lenient" else out
        got = sorted((r.dataset, r.ordinal, int(r.series_value[0])) for r in kept.collect())
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [i for i in range(400) if mode == "strict" or i % 7 != 2]
    assert got == [(n, k, i) for n in ("one", "two") for k, i in enumerate(want)]
    assert mode == "strict" or out[1].count() == 2 * (400 - len(want))
    assert not any("Sort" in x or "Window" in x for x in plan.splitlines() if "series_value" in x)


def test_folder_pipeline(spark, tmp_path):
    recordings(tmp_path)
    out = folder_features(spark, str(tmp_path), ["Acc.txt", "Gyro.txt"], resample_rate=1, time_unit=1.0, window_size=10,
                          pre_process=lambda s: s.withColumn("v", F.col("v") * 2), names=["Mean", "ECDF"])
    rows = out.collect()
    assert {r.series_id for r in rows} == {"Acc1", "Acc2", "Gyro1", "Gyro2"}
    assert {r.win_id for r in rows} == set(range(5))
    assert len(rows) == 2 * 4 * 5 * 11


def test_min_length_and_drop_missing(spark):
    s = spark.createDataFrame([("d", "a", i, None if i == 2 else float(i)) for i in range(5)] + [("d", "b", 0, 1.0)],
                              "dataset string, series_id string, idx bigint, y double")
    assert {r.series_id for r in files.min_length(s, 2).collect()} == {"a"}
    got = files.drop_missing(s).filter("series_id = 'a'").orderBy("idx").collect()
    assert [(r.idx, r.y) for r in got] == [(0, 0.0), (1, 1.0), (2, 3.0), (3, 4.0)]


def test_equal_stems_are_refused(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "d.csv").write_text("t,v\n1,2\n")
    with pytest.raises(ValueError, match="both be dataset d"):
        files.read_wide_csv(spark, [str(tmp_path / "a" / "d.csv"), str(tmp_path / "b" / "d.csv")])
