"""A catalogue of datasets, their columns, versions and runs, as tables of append-only Parquet.

Every change appends rows with a rising ``stamp``, and a look takes the latest row of each key; so writers never rewrite what
another reads. Data lie beside it as immutable versions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import json_at
from sysloom.operators import profile
from sysloom.operators.errors import SeriesError
from sysloom.operators.keep import kept, released
from sysloom.plans import cleanup

from . import csv, sinks

SCHEMAS = {
    "datasets": "dataset string, name string, sha256 string, path string, active string, deleted boolean, stamp long",
    "columns": "dataset string, column string, type string, role string, unit string, place int, stamp long",
    "versions": "version string, dataset string, parent string, path string, step string, parameters string, deleted boolean, stamp long",
    "runs": "run string, kind string, dataset string, version string, parameters string, result string, status string, stamp long",
}
KEYS = {"datasets": ["dataset"], "columns": ["dataset", "column"], "versions": ["version"], "runs": ["run"]}
ROLES = ("timestamp", "input", "output", "ignore")


def lineage(versions: DataFrame, child: str = "version", parent: str = "parent") -> DataFrame:
    """``version, parent, root, depth`` of every version, walking the edges up by pointer jumping: each round points every version
    at what its ancestor points at, so a chain of n takes log n rounds. A version whose parent is unknown is a root."""
    edges = versions.select(F.col(child).alias("version"), F.col(parent).alias("parent"))
    known = edges.select(F.col("version").alias("parent")).withColumn("known", F.lit(True))
    walk = edges.join(known, "parent", "left").select("version", "parent", F.when(F.col("known"), F.col("parent")).otherwise(F.col("version")).alias("root"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"))
    walk = kept(walk)
    while True:
        above = walk.select(F.col("version").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        jumped = kept(walk.join(above, "root").select("version", "parent", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        walk = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return walk


def belongs(dataset: str | None = None, version: str | None = None, dataset_column: str = "dataset", version_column: str = "version", parameters: str = "parameters") -> Column:
    """Whether a run is of a dataset or version: by its columns, or by the ids in its parameters."""
    tests = []
    if dataset is not None:
        tests += [F.col(dataset_column) == dataset, json_at(F.col(parameters), "dataset_id") == dataset]
    if version is not None:
        tests += [F.col(version_column) == version, json_at(F.col(parameters), "version_id") == version, json_at(F.col(parameters), "active_version_id") == version]
    if not tests:
        return F.lit(True)
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def summary(columns: DataFrame, by: str = "dataset") -> DataFrame:
    """``time_column, inputs, output`` of every dataset from its columns' roles; inputs in order of place."""
    inputs = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "input", F.struct("place", "column")))), lambda x: x["column"])
    return columns.groupBy(by).agg(F.max(F.when(F.col("role") == "timestamp", F.col("column"))).alias("time_column"), inputs.alias("inputs"), F.max(F.when(F.col("role") == "output", F.col("column"))).alias("output"))


class Catalogue:
    """Datasets under ``folder``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, name: str, rows: list[tuple]) -> None:
        stamp = time.time_ns()
        self.spark.createDataFrame([(*r, stamp) for r in rows], SCHEMAS[name]).write.mode("append").parquet(f"{self.folder}/{name}")

    def look(self, name: str) -> DataFrame:
        """The latest row of every key."""
        at, store, _ = sinks._files(self.spark, f"{self.folder}/{name}")
        if not store.exists(at):
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        last = F.row_number().over(Window.partitionBy(*KEYS[name]).orderBy(F.desc("stamp")))
        rows = rows.withColumn("__r", last).filter("__r = 1").drop("__r")
        return rows.filter("not coalesce(deleted, false)") if "deleted" in rows.columns else rows

    def register(self, path: str, name: str | None = None) -> str:
        """Take in a delimited text file as version 0 of a new dataset, or find the dataset that has its content already."""
        sha = csv.content_key(csv.staged(self.spark, path))
        if known := self.look("datasets").filter(F.col("sha256") == sha).first():
            return known.dataset
        table = csv.typed(csv.read(self.spark, path))
        dataset, version = uuid.uuid4().hex, uuid.uuid4().hex
        place = f"{self.folder}/data/{version}"
        sinks.write_version(table, place)
        at = csv.time_column(table.columns)
        kinds = {f.name: "datetime" if f.name == at else "float" if f.dataType.typeName() == "double" else "string" for f in table.schema.fields}
        role = {c: "timestamp" if c == at else "ignore" for c in table.columns}
        self._append("versions", [(version, dataset, None, place, "raw", "{}", False)])
        self._append("columns", [(dataset, c, kinds[c], role[c], None, i) for i, c in enumerate(table.columns)])
        self._append("datasets", [(dataset, name or path.rsplit("/", 1)[-1], sha, path, version, False)])
        return dataset

    def configure(self, dataset: str, output: str | None = None, inputs: list[str] | None = None, time_column: str | None = None, ignored: list[str] | None = None, units: Mapping[str, str] | None = None) -> None:
        """Set roles; those not named stay. There must be one time column, one output and an input in the end."""
        rows = {r.column: r for r in self.look("columns").filter(F.col("dataset") == dataset).collect()}
        if bad := sorted({*(inputs or []), *(ignored or []), *filter(None, [output, time_column])} - set(rows)):
            raise SeriesError("INVALID_DATASET_SCHEMA", f"unknown columns {bad}")
        role = {c: r.role for c, r in rows.items()}
        for kind, column in (("timestamp", time_column), ("output", output)):
            if column is not None:
                role = {c: "ignore" if r == kind else r for c, r in role.items()} | {column: kind}
        role |= dict.fromkeys(inputs or [], "input") | dict.fromkeys(ignored or [], "ignore")
        count = {k: sum(r == k for r in role.values()) for k in ROLES}
        if count["timestamp"] != 1 or count["output"] != 1 or count["input"] < 1:
            raise SeriesError("INVALID_DATASET_SCHEMA", f"roles {count}")
        self._append("columns", [(dataset, c, r.type, role[c], (units or {}).get(c, r.unit), r.place) for c, r in rows.items()])

    def version(self, version: str, dataset: str | None = None) -> DataFrame:
        """The table of a version."""
        row = self.look("versions").filter(F.col("version") == version).first()
        if row is None:
            raise SeriesError("DATASET_VERSION_NOT_FOUND", version)
        if dataset is not None and row.dataset != dataset:
            raise SeriesError("DATASET_VERSION_MISMATCH", f"{version} is of {row.dataset}")
        return self.spark.read.parquet(f"{row.path}/data")

    def active(self, dataset: str) -> str:
        row = self.look("datasets").filter(F.col("dataset") == dataset).first()
        if row is None:
            raise SeriesError("DATASET_VERSION_NOT_FOUND", dataset)
        return row.active

    def profile(self, dataset: str) -> DataFrame:
        """Quality of every numeric column of the active version."""
        table = self.version(self.active(dataset), dataset)
        at = next(f.name for f in table.schema.fields if f.dataType.typeName() == "timestamp")
        numeric = [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
        long = table.select(F.unix_micros(at).alias("t"), *numeric).unpivot("t", numeric, "series_id", "v")
        return profile.quality_profile(long, second=1e6)

    def clean(self, dataset: str, columns: list[str] | None = None, version: str | None = None, **parameters: Any) -> str:
        """A new version whose numeric columns are cleaned by ``cleanup.Cleaning(**parameters)`` (``period`` in seconds), child of ``version`` or
        of the active one, and active from now on. The run is kept with what changed in each column.

        Repeated times are settled first and every other row stays, so the new version has a row for each distinct time, or grid step.
        """
        parent = version or self.active(dataset)
        table = self.version(parent, dataset)
        at = next(f.name for f in table.schema.fields if f.dataType.typeName() == "timestamp")
        numeric = columns or [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
        plan = cleanup.Cleaning(**parameters | ({"period": parameters["period"] * 1e6} if parameters.get("period") else {}))
        rows = table.withColumns({at: F.unix_micros(at), "__series": F.lit(dataset), "__ord": F.monotonically_increasing_id()})
        rows = kept(cleanup.cleaned(rows, numeric, plan, "__series", at, "__ord"))
        version = uuid.uuid4().hex
        place = f"{self.folder}/data/{version}"
        try:
            sinks.write_version(rows.select(*[F.timestamp_micros(at).alias(at) if c == at else F.col(c) for c in table.columns]), place, parent)
        except BaseException:
            sinks.remove(self.spark, place)
            raise
        told = {r.column: {k: v for k, v in r.asDict().items() if k.startswith("n_")} for r in cleanup.summary(rows, numeric, "__series").collect()}  # a row a column
        released(rows)
        said = json.dumps(parameters, sort_keys=True)
        self._append("versions", [(version, dataset, parent, place, "clean", said, False)])
        row = self.look("datasets").filter(F.col("dataset") == dataset).first()
        self._append("datasets", [(row.dataset, row.name, row.sha256, row.path, version, False)])
        self.record("clean", dataset, parent, parameters, {"version": version, "columns": told})
        return version

    def record(self, kind: str, dataset: str | None, version: str | None, parameters: Mapping[str, Any], result: Mapping[str, Any], status: str = "done") -> str:
        """Keep an analysis run with what it was given and what it found."""
        run = uuid.uuid4().hex
        self._append("runs", [(run, kind, dataset, version, json.dumps(parameters, sort_keys=True, default=str), json.dumps(result, sort_keys=True, default=str), status)])
        return run

    def runs(self, dataset: str | None = None, version: str | None = None, kind: str | None = None) -> DataFrame:
        rows = self.look("runs").filter(belongs(dataset, version))
        return rows if kind is None else rows.filter(F.col("kind") == kind)

    def versions(self, dataset: str) -> DataFrame:
        return lineage(self.look("versions").filter(F.col("dataset") == dataset))

    def delete(self, dataset: str) -> None:
        """Forget a dataset and its versions; their files stay."""
        row = self.look("datasets").filter(F.col("dataset") == dataset).first()
        if row is None:
            raise SeriesError("DATASET_VERSION_NOT_FOUND", dataset)
        self._append("versions", [(r.version, r.dataset, r.parent, r.path, r.step, r.parameters, True) for r in self.look("versions").filter(F.col("dataset") == dataset).collect()])
        self._append("datasets", [(row.dataset, row.name, row.sha256, row.path, row.active, True)])
