"""Reading delimited text of unknown encoding, separator and types into typed series."""

from __future__ import annotations

import csv as text_csv
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sysloom.functions.scalars import is_missing, to_number
from sysloom.operators.errors import SeriesError

#: Names of time columns, and the formats tried after ISO 8601.
TIME_NAMES = ("timestamp", "time", "datetime", "date", "ts")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")
SAMPLE = 128 << 10
#: Column for the text of rows that can't be taken apart.
CORRUPT = "__corrupt"


def encoding_of(sample: bytes) -> str:
    """``utf-8`` (also with a byte-order mark), else ``gb18030`` if it decodes, else ``latin-1``. A cut last character is forgiven."""
    for name in ("utf-8", "gb18030"):
        for cut in range(4):
            try:
                sample[: len(sample) - cut].decode("utf-8-sig" if sample.startswith(b"\xef\xbb\xbf") and name == "utf-8" else name)
                return name
            except UnicodeDecodeError:
                continue
    return "latin-1"


def separator_of(sample: str) -> str:
    try:
        return text_csv.Sniffer().sniff(sample, ",;\t").delimiter
    except text_csv.Error:
        return ","


def time_column(names: list[str]) -> str:
    """The one column whose name says that it holds times."""
    found = [n for n in names if n.strip().lower() in TIME_NAMES or n.strip().lower().endswith(("_time", "_timestamp")) or "时间" in n or "日期" in n]
    if len(found) != 1:
        raise SeriesError("INVALID_DATASET_SCHEMA", f"{len(found)} time columns")
    return found[0]


def timestamp(c: Column) -> Column:
    """A text as a time in UTC: Unix seconds (milliseconds above 1e10), ISO 8601 with or without zone, or one of ``FORMATS``; else null."""
    s = F.trim(c)
    number = F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    unix = F.timestamp_micros(F.when(F.abs(number) > 1e10, number * 1e3).otherwise(number * 1e6).cast("long"))
    return F.coalesce(unix, s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS])


def inferred(df: DataFrame) -> DataFrame:
    """``column, type`` of every text column: datetime, boolean, integer, float or string, by the values present. One aggregate."""
    tests = {"datetime": lambda c: c.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}") & timestamp(c).isNotNull(), "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false", "0", "1"), "integer": lambda c: F.trim(c).rlike(r"^[+-]?[0-9]+$"), "float": lambda c: to_number(c).isNotNull()}
    row = df.agg(*[F.bool_and(F.when(~is_missing(F.col(c)), t(F.col(c)))).alias(f"{c}|{k}") for c in df.columns for k, t in tests.items()])
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(*[F.when(F.col(f"`{c}|{k}`"), F.lit(k)) for k in tests], F.lit("string")).alias("type")) for c in df.columns])
    return row.select(F.explode(names).alias("x")).select("x.column", "x.type")


def head(spark: SparkSession, path: str, size: int = SAMPLE) -> bytes:
    """The first bytes of the file at ``path``, or of the first file in it, through Hadoop's file systems; no more is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if store.getFileStatus(at).isDirectory():
        names = sorted(x.getPath().toString() for x in store.listStatus(at) if x.isFile() and not x.getPath().getName().startswith(("_", ".")))
        if not names:
            return b""
        at = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = store.open(at)
    try:
        bounded = jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text, blank rows left out; encoding and separator from the first bytes.

    Empty or repeated column names, rows of another number of fields, wholly empty columns and a table without rows are errors.
    """
    sample = head(spark, path)
    if not sample:
        raise SeriesError("INVALID_DATASET_SCHEMA", "empty file")
    name = encoding_of(sample)
    text = sample.decode(name, "ignore").lstrip("\ufeff")
    columns = [c.strip() for c in next(text_csv.reader([text.splitlines()[0]], delimiter=separator_of(text)))]
    if len(set(columns)) < len(columns) or not all(columns):
        raise SeriesError("INVALID_DATASET_SCHEMA", "empty or repeated column names")
    if name == "gb18030":  # Spark admits such charsets only under this setting
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    rows = spark.read.csv(path, schema=schema, header=True, sep=separator_of(text), encoding=name, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
    blank = F.coalesce(F.col(CORRUPT), F.lit("")).rlike(f"^[\\s{separator_of(text)}\"]*$")
    rows = rows.filter(~(blank & F.forall(F.array(*[F.col(f"`{c}`") for c in columns]), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")))
    _validated(spark, rows, columns, path, name)
    return rows.select(*[F.trim(f"`{c}`").alias(c) for c in columns])


def _validated(spark: SparkSession, rows: DataFrame, columns: list[str], path: str, encoding: str) -> None:
    """Errors for rows whose number of fields is not the header's (with the line), for a table without rows and for wholly empty columns; one
    aggregate over the file."""
    present = [F.count_if(~is_missing(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(columns)]
    seen = rows.agg(F.count("*").alias("n"), F.count(CORRUPT).alias("bad"), *present).first()
    if seen.bad:
        line, text = _line(spark, rows, path, encoding)
        raise SeriesError("INVALID_DATASET_SCHEMA", f"line {line} has not {len(columns)} fields: {text[:80]}")
    if not seen.n:
        raise SeriesError("INSUFFICIENT_ROWS", "no row of data")
    if empty := [c for i, c in enumerate(columns) if not seen[f"n{i}"]]:
        raise SeriesError("INVALID_DATASET_SCHEMA", f"empty columns {empty}")


def _line(spark: SparkSession, rows: DataFrame, path: str, encoding: str) -> tuple[int, str]:
    """Number (the header's is 1) and text of the first line that could not be taken apart. Only an error costs this second pass."""
    bad = rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value")).distinct()
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.monotonically_increasing_id().alias("place"))
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", ""))
    first = lines.join(bad, "value", "left_semi").orderBy("place").first()
    return (lines.filter(F.col("place") <= first.place).count(), first.value) if first else (0, "")


def _sha256(path: str) -> str | None:
    """Digest of a file, read piece by piece; none where only Spark can open its store."""
    from pyarrow import fs

    try:
        store, at = fs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError):
        return None
    digest = hashlib.sha256()
    with store.open_input_stream(at, compression=None) as f:
        while piece := f.read(8 << 20):
            digest.update(piece)
    return digest.hexdigest()


def staged(spark: SparkSession, path: str, most: int | None = None, suffixes: tuple[str, ...] = (".csv", ".txt")) -> DataFrame:
    """``path, bytes, sha256`` of every file at ``path``, a file of any size hashed as a stream in a task; a file over ``most`` bytes or of
    another kind is an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))  # sizes and names come without contents
    other = ~F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$")
    bad = listed.filter(other | (F.lit(most is not None) & (F.col("bytes") > (most or 0)))).first()
    if bad:
        raise SeriesError("INVALID_DATASET_SCHEMA", f"not accepted: {bad.path}")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_sha256(p) for p in batch.column(0).to_pylist()], pa.string())], ["path", "bytes", "sha256"])

    out = listed.mapInArrow(hashed, "path string, bytes long, sha256 string")
    if out.filter("sha256 is null").isEmpty():
        return out
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_key(files: DataFrame) -> str:
    """One digest of all files that ``staged`` lists: a file's own, or that of the sorted list of theirs."""
    every = sorted(r.sha256 for r in files.select("sha256").collect())  # a row a file
    return every[0] if len(every) == 1 else hashlib.sha256("\n".join(every).encode()).hexdigest()


def typed(df: DataFrame) -> DataFrame:
    """Times parsed, numeric columns as doubles with missing values as null; a time that doesn't parse is an error."""
    at = time_column(df.columns)
    types = {r.column: r.type for r in inferred(df).collect()}
    bad = df.filter(timestamp(F.col(at)).isNull()).limit(1).count()
    if bad:
        raise SeriesError("TIMESTAMP_PARSE_FAILED", at)
    return df.select(timestamp(F.col(at)).alias(at), *[to_number(F.col(c)).alias(c) if types[c] in ("integer", "float") else F.when(~is_missing(F.col(c)), F.col(c)).alias(c) for c in df.columns if c != at])


def roles(df: DataFrame, output: str | None = None, inputs: list[str] | None = None, declared_output: str | None = None, declared_inputs: list[str] | None = None) -> tuple[list[str], str]:
    """Inputs and output of a model: as asked for, else as declared, else every other numeric column by name.

    Unknown or non-numeric columns, an output among the inputs and a lack of either are errors.
    """
    numeric = sorted(f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal"))
    target = output or declared_output
    if target is None or target not in numeric:
        raise SeriesError("INVALID_DATASET_SCHEMA", f"no numeric output column: {target}")
    chosen = list(inputs or declared_inputs or []) or [c for c in numeric if c != target]
    if bad := sorted(set(chosen) - set(numeric)):
        raise SeriesError("INVALID_DATASET_SCHEMA", f"unknown or non-numeric inputs {bad}")
    if target in chosen:
        raise SeriesError("INVALID_DATASET_SCHEMA", f"{target} is both input and output")
    if not chosen:
        raise SeriesError("NO_NUMERIC_SIGNAL", "no inputs")
    return chosen, target


def preview(df: DataFrame, types: dict[str, str], order: str, rows: int = 100) -> DataFrame:
    """The first ``rows`` of a text table by ``order``, each column as its type says; what doesn't fit is null."""
    kinds = {"integer": lambda c: F.trim(c).try_cast("long"), "float": to_number, "boolean": lambda c: F.lower(F.trim(c)).isin("true", "1"), "datetime": timestamp}
    shown = [F.when(~is_missing(F.col(c)), kinds[types[c]](F.col(c)) if types.get(c) in kinds else F.col(c)).alias(c) for c in df.columns]
    return df.orderBy(order).limit(rows).select(*shown)
