import pytest

from sysloom.operators.errors import SeriesError
from sysloom.plans import study
from sysloom.plans.steps import Steps
from sysloom.sources import catalogue, sinks
from sysloom.sources.catalogue import Catalogue
from sysloom.sources.series import daily, table
from sysloom.sources.sinks import checksum, export, write_version
from sysloom.streaming.monitor import windowed_quality


def test_steps_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    steps = Steps(spark, str(tmp_path))
    a, df = steps.run("root", "count", "1", {"x": 1.0}, make)
    b, again = steps.run("root", "count", "1", {"x": 1.00000000001}, make)
    c, _ = steps.run(a, "count", "1", {"x": 1.0}, make)
    assert a == b != c and df.count() == again.count() == 5 and len(made) == 2 and (steps.hits, steps.misses) == (1, 2)


def test_versions_are_written_once(spark, sf, tmp_path):
    df = daily(spark, sf)
    row = write_version(df, str(tmp_path / "v1")).first()
    assert (row.n_rows, row.checksum) == tuple(checksum(df.repartition(3)).first())
    with pytest.raises(Exception, match="(?i)exist"):
        write_version(df, str(tmp_path / "v1"))
    manifest = export(df, df.filter("t % 2 = 0"), ["u1", "y"], str(tmp_path / "out")).collect()
    assert all(0.45 < r.coverage <= 0.55 for r in manifest)
    assert spark.read.csv(str(tmp_path / "out/rows"), header=True).columns == ["series_id", "t", "u1", "y"]


def test_stream_equals_table(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_quality(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("quality").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = spark.sql("select start, event_type, n from quality").collect()
    finally:
        q.stop()
    assert sorted(map(tuple, got)) == sorted(map(tuple, windowed_quality(events).select("start", "event_type", "n").collect()))


def test_derived_text_is_whole_or_absent(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "v2")
    df = spark.createDataFrame([(3, 1 / 3, None), (1, None, "a"), (2, 2.0, "b,c")], "t long, x double, note string")
    manifest = sinks.write_derived(df, path, ["t"], "v1").collect()
    files = sorted((tmp_path / "v2" / "rows").glob("part-*.csv"))
    text = [f.read_text() for f in files]
    lines = [line for t in text for line in t.splitlines()[1:]]
    assert lines == ["1,,a", '2,2,"b,c"', "3,0.333333333333,"]
    assert {m.file: m.sha256 for m in manifest} == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in files} and {m.parent for m in manifest} == {"v1"}
    with pytest.raises(FileExistsError):
        sinks.write_derived(df, path, ["t"])
    with pytest.raises(Exception):
        sinks.write_derived(df.selectExpr("t", "assert_true(t > 5) AS x"), str(tmp_path / "v3"), ["t"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v2"] and not sinks.remove(spark, str(tmp_path / "v3"))
    models = spark.createDataFrame([("s", [1.0, 2.0])], "series_id string, theta array<double>")
    assert sinks.write_models(models, str(tmp_path / "m"), {"version": "v1"}).first().theta == [1.0, 2.0]
    with pytest.raises(FileExistsError):
        sinks.write_models(models, str(tmp_path / "m"), {})


def test_lineage_of_branching_trees(spark):
    import random

    g, parent = random.Random(1), {0: None, 500: None, 900: -1}
    for i in [*range(1, 60), *range(501, 520)]:
        parent[i] = g.choice([k for k in parent if k < i and (k < 500) == (i < 500)])
    got = {r.version: (r.root, r.depth) for r in catalogue.lineage(spark.createDataFrame(list(parent.items()), "version long, parent long")).collect()}

    def walk(v):
        depth = 0
        while parent.get(v) is not None and parent[v] in parent:
            v, depth = parent[v], depth + 1
        return v, depth

    assert got == {v: walk(v) for v in parent}


def test_catalogue(spark, tmp_path):
    source = tmp_path / "plant.csv"
    rows = [f"2026-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d},{i % 7 + 0.5},{'' if i in (5, 6) else i % 5 + 0.25},{i * 0.5 + (300 if i == 50 else 0)}" for i in range(200)]
    source.write_text("time,u1,u2,y\n" + "\n".join(rows) + "\n")
    cat = Catalogue(spark, str(tmp_path / "cat"))
    dataset = cat.register(str(source), "plant")
    assert cat.register(str(source)) == dataset and cat.look("datasets").count() == 1
    with pytest.raises(SeriesError):
        cat.configure(dataset, output="y")
    with pytest.raises(SeriesError):
        cat.configure(dataset, output="nope", inputs=["u1"])
    cat.configure(dataset, output="y", inputs=["u1", "u2"], units={"y": "t/h"})
    row = catalogue.summary(cat.look("columns")).first()
    assert (row.time_column, row.inputs, row.output) == ("time", ["u1", "u2"], "y")
    first = cat.active(dataset)
    profile = {r.series_id: r for r in cat.profile(dataset).collect()}
    assert profile["u2"].n_missing == 2 and profile["u1"].sample_period_seconds == 1.0
    second = cat.clean(dataset)
    table = cat.version(second, dataset)
    assert cat.active(dataset) == second and table.count() == 200 and table.filter("u2 is null").count() == 0 and table.agg({"y": "max"}).first()[0] < 120
    assert {(r.version, r.depth) for r in cat.versions(dataset).collect()} == {(first, 0), (second, 1)}
    cat.record("delay", None, None, {"version_id": second, "dataset_id": "other"}, {"u1": 2})
    assert cat.runs(dataset).count() == 1 and cat.runs(version=second).count() == 1 and cat.runs("other").count() == 1 and cat.runs().count() == 2 and cat.runs(kind="clean").count() == 1
    with pytest.raises(SeriesError):
        cat.version("none")
    with pytest.raises(SeriesError):
        cat.version(first, "other")
    cat.delete(dataset)
    assert cat.look("datasets").count() == 0 and cat.look("versions").count() == 0 and (tmp_path / "cat" / "data" / second).exists()


def plant(path):
    """The plant of the cleaning tests: a square wave drives a ramp with one spike and a gap; two rows share a time."""
    lines = ["timestamp,u1,y,note"]
    for i in range(400):
        y = "" if 200 <= i <= 204 else f"{0.5 * (1 if i // 40 % 2 == 0 else -1) + 0.01 * i + (50 if i == 120 else 0):.6f}"
        lines.append(f"2026-01-01 00:{i // 60:02d}:{i % 60:02d},{1.5 if i // 40 % 2 == 0 else -1.5},{y},n{i % 3}")
    lines += ["2026-01-01 00:00:10,1.5,98.5,late", "2026-01-01 00:00:10,1.5,99.5,later"]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_cleaned_versions_keep_every_time_and_say_what_changed(spark, tmp_path):
    import json

    cat = Catalogue(spark, str(tmp_path / "cat"))
    dataset = cat.register(plant(tmp_path / "plant.csv"))
    raw = cat.active(dataset)
    before = sorted(map(tuple, cat.version(raw).collect()), key=repr)
    one = cat.clean(dataset, treatment="local_median", period=1.0, threshold=4.0)
    two = cat.clean(dataset, version=raw, treatment="set_null", duplicates="first")
    assert sorted(map(tuple, cat.version(raw).collect()), key=repr) == before and len(before) == 402
    assert {(r.version, r.parent) for r in cat.versions(dataset).select("version", "parent").collect()} == {(raw, None), (one, raw), (two, raw)} and cat.active(dataset) == two
    a, b = ({r.timestamp.minute * 60 + r.timestamp.second: r for r in cat.version(v).collect()} for v in (one, two))
    assert len(a) == len(b) == 400 and cat.version(one).count() == cat.version(two).count() == 400
    assert cat.version(one).columns == cat.version(raw).columns
    # repeated times are settled by name, a value is never given to another time
    assert a[9].note == "n0" and a[10].note == "n1" and a[11].y < 1 and b[10].y is not None and abs(b[10].y - 0.6) < 1e-6
    assert a[120].y < 3 and b[120].y is None and all(r.y is not None for r in a.values()) and abs(a[202].y - (a[199].y + a[205].y) / 2) < 1e-9
    runs = {json.loads(r.result)["version"]: json.loads(r.result)["columns"] for r in cat.runs(kind="clean").collect()}
    assert runs[one]["y"]["n_filled"] == 5 and runs[one]["y"]["n_duplicates"] == 2 and runs[one]["y"]["n_outliers"] >= 1 and runs[two]["y"]["n_missing"] >= 1
    with pytest.raises(SeriesError) as e:
        cat.clean(dataset, version="none")
    assert e.value.code == "DATASET_VERSION_NOT_FOUND"
    with pytest.raises(SeriesError):
        cat.clean(dataset, detector="guess")


def test_kept_tables_are_released(spark, tmp_path):
    from sysloom.operators import keep

    spark.sparkContext.setCheckpointDir(str(tmp_path / "points"))  # stays set for the rest of the session
    files = lambda: [f for f in (tmp_path / "points").rglob("part-*") if f.is_file()]
    with keep.releasing():
        held = keep.kept(spark.range(100))
        assert held.count() == 100 and files()
    assert not files()
    cached = spark.range(7).persist()
    keep.released(cached)
    assert not cached.is_cached


def test_studies_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "studies")
    study.persisted(spark.range(3).withColumnRenamed("id", "study_trial"), path, "a")
    study.persisted(spark.range(2).withColumnRenamed("id", "study_trial"), path, "b")
    assert study.persisted(spark.range(5).withColumnRenamed("id", "study_trial"), path, "a").count() == 5 and spark.read.parquet(path).count() == 7
