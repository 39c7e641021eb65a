"""Writing versions of series once, and exporting selected rows with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysloom.operators.profile import AT, KEY


def checksum(df: DataFrame) -> DataFrame:
    """``n_rows, checksum`` of a table, whatever the order of its rows: a sum of row hashes (64 bits of an MD5), so repeated rows count.

    A row is its columns in order of name, joined by bars; numbers with fractions to six places, nulls empty.
    """
    text = [F.coalesce(F.format_string("%.6f", F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string"), F.lit("")) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    text = [F.when(F.col(f.name).isNull(), "").otherwise(t) for f, t in zip(sorted(df.schema.fields, key=lambda f: f.name), text, strict=True)]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def write_version(df: DataFrame, path: str, parent: str | None = None) -> DataFrame:
    """Write ``df`` as an immutable version (an existing path is an error); returns its manifest row."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    manifest = checksum(stored).withColumns({"path": F.lit(path), "parent": F.lit(parent).cast("string")})
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def number(c: Column) -> Column:
    """A double in at most twelve significant digits, as ``%.12g`` writes it (an exact half of the last digit goes up); missing values as the empty text."""
    exponent = F.when(c == 0, 0).otherwise(F.regexp_extract(F.format_string("%.11e", c), "e([+-][0-9]+)$", 1).try_cast("int"))
    shorn = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")
    fixed = F.format_string("%s", shorn(_fixed(c, exponent)))
    text = F.when((exponent < -4) | (exponent >= 12), shorn(F.format_string("%.11e", c))).otherwise(fixed)
    return F.when(c.isNull() | F.isnan(c), "").otherwise(text)


def _fixed(c: Column, exponent: Column) -> Column:
    """``c`` with eleven less ``exponent`` digits after the point."""
    out = F.format_string("%.0f", c)
    for k in range(1, 16):
        out = F.when(F.lit(11) - exponent == k, F.format_string(f"%.{k}f", c)).otherwise(out)
    return out


def _files(spark, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_derived(df: DataFrame, path: str, order: list[str], parent: str | None = None) -> DataFrame:
    """Write ``df`` as delimited text in the order of ``order``, numbers in twelve digits, as an immutable version; returns the manifest.

    Rows are sorted by ranges, so files in order of name hold the table in order. Everything goes to a staging folder first, which
    is moved into place when whole; a failure deletes it and an existing version is an error. The manifest has the SHA-256 of every file.
    """
    spark = df.sparkSession
    at, store, jvm = _files(spark, path)
    if store.exists(at):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    columns = [number(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields]
    try:
        df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).write.option("header", True).option("emptyValue", "").csv(f"{staging}/rows")
        hashed = spark.read.format("binaryFile").load(f"{staging}/rows").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        hashed.withColumn("parent", F.lit(parent).cast("string")).write.json(f"{staging}/manifest")
        if not store.rename(jvm.org.apache.hadoop.fs.Path(staging), at):
            raise FileExistsError(path)
    except BaseException:
        remove(spark, staging)
        raise
    return spark.read.schema("file string, bytes long, sha256 string, parent string").json(f"{path}/manifest")


def remove(spark, path: str) -> bool:
    """Delete what a failed write has left; whether there was anything."""
    at, store, _ = _files(spark, path)
    return store.exists(at) and store.delete(at, True)


def write_models(models: DataFrame, path: str, about: dict[str, str]) -> DataFrame:
    """Write models as JSON with what is known about them, to a staging folder that is moved into place; an existing path is an error."""
    spark = models.sparkSession
    at, store, jvm = _files(spark, path)
    if store.exists(at):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        models.withColumns({k: F.lit(v) for k, v in about.items()}).write.json(staging)
        if not store.rename(jvm.org.apache.hadoop.fs.Path(staging), at):
            raise FileExistsError(path)
    except BaseException:
        remove(spark, staging)
        raise
    return spark.read.json(path)


def selected(df: DataFrame, rows: DataFrame, columns: list[str], by: str = KEY, at: str = AT) -> DataFrame:
    """The steps of ``df`` that ``rows`` lists, in order, with the columns asked for."""
    return df.join(rows.select(by, at).distinct(), [by, at], "left_semi").select(by, at, *columns).orderBy(by, at)


def export(df: DataFrame, rows: DataFrame, columns: list[str], path: str, by: str = KEY, at: str = AT) -> DataFrame:
    """Write the selected steps as delimited text and return the share of each series that they cover."""
    out = selected(df, rows, columns, by, at)
    out.write.mode("errorifexists").option("header", True).csv(f"{path}/rows")
    kept = out.groupBy(by).agg(F.count("*").alias("n_selected"))
    whole = df.groupBy(by).agg(F.count("*").alias("n_rows"))
    manifest = whole.join(kept, by, "left").select(by, "n_rows", F.coalesce("n_selected", F.lit(0)).alias("n_selected")).withColumn("coverage", F.col("n_selected") / F.col("n_rows"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest
