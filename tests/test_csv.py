import pytest

from sysloom.operators.errors import SeriesError
from sysloom.sources import csv


def put(tmp_path, data):
    path = tmp_path / "x.csv"
    path.write_bytes(data)
    return str(path)


def test_small_file(spark, tmp_path):
    text = "timestamp,u1,y,note\n2026-01-01T00:00:00Z,0,1.5,a\n1767225601,1,NA,b\n2026/01/01 00:00:02,,100,\n"
    df = csv.read(spark, put(tmp_path, text.encode()))
    assert {r.column: r.type for r in csv.inferred(df.drop("timestamp")).collect()} == {"u1": "boolean", "y": "float", "note": "string"}
    rows = csv.typed(df).collect()
    assert [r.y for r in rows] == [1.5, None, 100.0]
    assert sorted(r.timestamp.second for r in rows) == [0, 1, 2]


def test_gbk_and_semicolon(spark, tmp_path):
    path = put(tmp_path, "时间;u1;y\n2026-01-01 00:00:00;1;2\n2026-01-01 00:00:01;2;3\n".encode("gbk"))
    df = csv.read(spark, path)
    assert csv.time_column(df.columns) == "时间" and df.count() == 2


@pytest.mark.parametrize(("text", "code"), [("u1,y\n1,2\n", "INVALID_DATASET_SCHEMA"), ("time,y\nnever,2\n", "TIMESTAMP_PARSE_FAILED"), ("time,y,y\n2026-01-01,2,3\n", "INVALID_DATASET_SCHEMA"), ("", "INVALID_DATASET_SCHEMA")])
def test_bad_files(spark, tmp_path, text, code):
    with pytest.raises(SeriesError) as e:
        csv.typed(csv.read(spark, put(tmp_path, text.encode())))
    assert e.value.code == code


def refused(spark, tmp_path, data, code, text=""):
    with pytest.raises(SeriesError) as e:
        csv.typed(csv.read(spark, put(tmp_path, data)))
    assert e.value.code == code and text in str(e.value), e.value


def test_the_malformed_files_get_their_codes(spark, tmp_path):
    refused(spark, tmp_path, b"u1,y\n1,2\n2,3\n", "INVALID_DATASET_SCHEMA")
    refused(spark, tmp_path, b"timestamp,u1,y\nnot-a-time,1,2\n", "TIMESTAMP_PARSE_FAILED")
    refused(spark, tmp_path, b"timestamp,u1,y\n2026-01-01 00:00:00,,1\n", "INVALID_DATASET_SCHEMA", "u1")
    refused(spark, tmp_path, b"timestamp,u1,u1\n2026-01-01 00:00:00,1,2\n", "INVALID_DATASET_SCHEMA")
    refused(spark, tmp_path, b"timestamp,u1,y\n", "INSUFFICIENT_ROWS")
    refused(spark, tmp_path, b"timestamp,u1,y\n\n,,\n  , ,\n", "INSUFFICIENT_ROWS")
    refused(spark, tmp_path, b"timestamp,u1,y\n2026-01-01,NA, null \n2026-01-02,,2\n", "INVALID_DATASET_SCHEMA", "u1")
    refused(spark, tmp_path, b"timestamp,u1,y\n" + b"2026-01-01,1,2\n" * 5 + b"2026-01-02,1\n2026-01-02,1,2,3\n", "INVALID_DATASET_SCHEMA", "line 7 ")
    refused(spark, tmp_path, b"timestamp,u1,y\n2026-01-01,1,2\n2026-01-02,1,2,3\n", "INVALID_DATASET_SCHEMA", "line 3 ")


def test_blank_rows_quotes_and_spaces(spark, tmp_path):
    rows = csv.typed(csv.read(spark, put(tmp_path, b'time,y,note\n2026-01-01, 1.5 ,"a, ""b"""\n\n,,\n2026-01-02,2,\n'))).collect()
    assert [(r.y, r.note) for r in sorted(rows, key=lambda r: r.time)] == [(1.5, 'a, "b"'), (2.0, None)]


def test_folders_are_known_by_all_their_files(spark, tmp_path):
    import hashlib

    data = [b"time,y\n2026-01-01,1\n", b"time,y\n2026-01-02,2\n"]
    for i, d in enumerate(data):
        (tmp_path / f"{i}.csv").write_bytes(d)
    one, both = csv.content_key(csv.staged(spark, str(tmp_path / "0.csv"))), csv.content_key(csv.staged(spark, str(tmp_path)))
    shas = sorted(hashlib.sha256(d).hexdigest() for d in data)
    assert one == hashlib.sha256(data[0]).hexdigest() and both == hashlib.sha256("\n".join(shas).encode()).hexdigest()


def test_head_and_staging_read_what_they_need(spark, tmp_path):
    big = tmp_path / "big.csv"
    big.write_bytes(b"time,y\n" + b"2026-01-01,1\n" * 100_000)
    assert csv.head(spark, str(big), 10) == b"time,y\n202" and csv.head(spark, str(tmp_path), 4) == b"time"
    row = csv.staged(spark, str(big)).first()
    assert row.bytes == big.stat().st_size and len(row.sha256) == 64
    with pytest.raises(SeriesError):
        csv.staged(spark, str(big), most=1000)
    (tmp_path / "x.exe").write_bytes(b"a")
    with pytest.raises(SeriesError):
        csv.staged(spark, str(tmp_path / "x.exe"))


def test_roles_and_preview(spark, tmp_path):
    df = csv.typed(csv.read(spark, put(tmp_path, b"time,u2,u1,y,note\n2026-01-01,1.5,2.5,3.5,a\n2026-01-02,2,3,4,b\n")))
    assert csv.roles(df, "y") == (["u1", "u2"], "y") and csv.roles(df, "y", ["u2"]) == (["u2"], "y")
    assert csv.roles(df, declared_output="y", declared_inputs=["u1"]) == (["u1"], "y") and csv.roles(df, "u1", declared_output="y") == (["u2", "y"], "u1")
    for output, inputs in ((None, None), ("note", None), ("y", ["nope"]), ("y", ["y"]), ("y", ["note"])):
        with pytest.raises(SeriesError):
            csv.roles(df, output, inputs)
    text = spark.createDataFrame([(str(i), "NA" if i == 2 else f"{i}.5", "TRUE", "x") for i in range(150)], "i string, f string, b string, s string")
    shown = csv.preview(text.selectExpr("lpad(i, 3, '0') AS i", "f", "b", "s"), {"i": "integer", "f": "float", "b": "boolean", "s": "string"}, "i").collect()
    assert len(shown) == 100 and tuple(shown[2]) == (2, None, True, "x") and shown[3].f == 3.5
