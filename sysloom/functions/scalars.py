"""Scalar expressions whose edge cases the operators rely on."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "missing", compared without case and outer blanks.
MISSING = ["", "na", "n/a", "null", "none", "nan"]


def is_missing(c: Column) -> Column:
    """Null, or a text that stands for a missing value."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(MISSING)


def finite(c: Column) -> Column:
    """``c`` as double with NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def to_number(c: Column) -> Column:
    """A text as a finite double; anything else is null."""
    return F.when(~is_missing(c), finite(F.trim(c).try_cast("double")))


def close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Equal within a relative or an absolute tolerance; null if either is null."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def scrubbed(c: Column, fallback: float | None = 0.0) -> Column:
    """``c`` with null, NaN and infinities replaced."""
    return F.coalesce(finite(c), F.lit(fallback))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; infinite where their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))).otherwise(float("inf"))


def fit_percent(actual: Column, predicted: Column, floor: float | None = -100.0) -> Column:
    """Aggregate: 100 (1 - |e| / |y - mean y|), not under ``floor``; null for a constant target."""
    rss, spread = F.sum((actual - predicted) * (actual - predicted)), F.var_pop(actual) * F.count(actual)
    value = F.when(spread > 0, 100 * (1 - F.sqrt(rss / spread)))
    return value if floor is None else F.when(value.isNotNull(), F.greatest(F.lit(floor), value))


def scores(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates rmse, mae, r2, fit (without floor) and nrmse (over the spread of the middle nine tenths)."""
    e = actual - predicted
    rss, spread = F.sum(e * e), F.var_pop(actual) * F.count(actual)
    p = F.percentile(actual, F.lit(0.95)) - F.percentile(actual, F.lit(0.05))
    rmse = F.sqrt(F.avg(e * e))
    return {"rmse": rmse, "mae": F.avg(F.abs(e)), "r2": F.when(spread > 0, 1 - rss / spread), "fit": fit_percent(actual, predicted, None), "nrmse": F.when(p > 0, rmse / p)}


def number_text(c: Column, places: int = 4) -> Column:
    """A double as text: scientific from 1e5 on and below 1e-4, else without trailing zeros; infinities as signs, NaN as ``n/a``."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", c), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    text = F.when((F.abs(c) >= 1e5) | ((c != 0) & (F.abs(c) < 1e-4)), F.format_string(f"%.{places}e", c)).otherwise(F.when(plain == "", "0").otherwise(plain))
    return F.when(c.isNull() | F.isnan(c), "n/a").when(c == float("inf"), "∞").when(c == float("-inf"), "-∞").otherwise(text)


def json_at(c: Column, path: str) -> Column:
    """The value at a dotted path of names and list places in a JSON text; null where it leads nowhere."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.when(F.lit("" not in path.split(".")), F.get_json_object(c, "$" + steps))


def canonical(value: Any) -> Any:
    """Nested values in a form whose JSON text doesn't depend on key order or on float noise."""
    if isinstance(value, float):
        return str(value) if math.isnan(value) or math.isinf(value) else round(value, 9)
    if isinstance(value, Mapping):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return value


def step_key(parent: str, step: str, version: str, parameters: Mapping[str, Any], code: str = "") -> str:
    """Content address of a step's result: a hash over what it was made from and how."""
    body = {"code": code, "parameters": canonical(parameters), "parent": parent, "step": step, "version": version}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
