"""Quality gate: metrics, thresholds, breaches, findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class QualityGateError(RuntimeError):
    """A breach that withholds publication."""


def coverage(present: Column) -> Column:
    """Share of rows where a value is present; zero without rows."""
    return F.coalesce(F.avg(F.when(present, 1.0).otherwise(0.0)), F.lit(0.0))


def coverage_by(df: DataFrame, group: str, fields: dict[str, Column]) -> DataFrame:
    """Coverage of each field by group, and over all as group ALL."""
    out = df.rollup(group).agg(F.grouping(group).alias("__all"), F.count("*").alias("n"), *(F.bround(coverage(c), 4).alias(k) for k, c in fields.items()))
    return out.withColumn(group, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(group))).drop("__all")


def breaches(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds (metric, op, limit, area) that their metric (metric, area,
    value) breaks. Without the metric a threshold is skipped; a floor for an
    area that a measured metric lacks is a breach."""
    measured = metrics.select("metric").distinct().withColumn("measured", F.lit(True))
    own = metrics.select("metric", F.coalesce("area", F.lit("")).alias("a"), "value")
    j = thresholds.withColumn("a", F.coalesce("area", F.lit(""))).join(measured, "metric").join(own, ["metric", "a"], "left")
    broken = F.col("value").isNull() | F.when(F.col("op") == "min", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return j.where(broken).select("metric", "area", "op", "limit", "value")


def unmeasured(metrics: DataFrame, thresholds: DataFrame, optional: list[str] = ()) -> DataFrame:
    """Thresholds whose metric was never measured: they guard nothing."""
    return thresholds.where(~F.col("metric").isin(list(optional)) if optional else F.lit(True)).join(metrics.select("metric").distinct(), "metric", "left_anti").select("metric").distinct()


def unreachable_floors(metrics: DataFrame, thresholds: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Floors above the share that can be reached at all (metric, area,
    ceiling), where the value also falls short."""
    j = thresholds.where("op = 'min'").join(ceilings, ["metric", "area"]).join(metrics, ["metric", "area"])
    return j.where((F.col("limit") > F.col("ceiling")) & (F.col("value") < F.col("limit"))).select("metric", "area", "limit", "ceiling", "value")


def findings(df: DataFrame, key: str, rules: dict[str, Column], shown: int = 8) -> DataFrame:
    """(label, n, first): how many rows break each rule and the first few keys,
    in one pass."""
    flags = [F.struct(F.lit(k).alias("label"), F.coalesce(c, F.lit(False)).alias("bad")) for k, c in rules.items()]
    rows = df.select(F.col(key).alias("k"), F.explode(F.array(*flags)).alias("f")).select("k", "f.*").where("bad")
    # each task keeps the smallest keys only
    part = rows.groupBy("label", F.pmod(F.xxhash64("k"), F.lit(64)).alias("p")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("k")), 1, shown).alias("few"))
    firsts = F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, shown)
    return part.groupBy("label").agg(F.sum("n").alias("n"), F.array_join(F.transform(firsts, lambda x: x.cast("string")), ",").alias("first"))


def residual_defects(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(field, pattern, n): matches of each pattern in every string column."""
    fields = [f for f, t in df.dtypes if t == "string"]
    sums = [F.coalesce(F.sum(F.regexp_count(F.col(f), F.lit(p))), F.lit(0)).alias(f"{f}|{k}") for f in fields for k, p in patterns.items()]
    wide = df.agg(*sums)
    pairs = [F.struct(F.lit(f).alias("field"), F.lit(k).alias("pattern"), F.col(f"{f}|{k}").alias("n")) for f in fields for k in patterns]
    return wide.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def leaked_values(df: DataFrame, slices: Column) -> DataFrame:
    """Total observation values in an array of excerpts."""
    return df.select(F.explode(slices).alias("s")).agg(F.coalesce(F.sum(F.regexp_count("s", F.lit(T.VALUE_TOKEN))), F.lit(0)).alias("leaks"))


def require(df: DataFrame, checks: dict[str, tuple[Column, Callable[[object], bool]]]) -> DataFrame:
    """Floors before a sink: aggregates ``df`` once and raises on any check that
    fails, naming it; returns ``df``."""
    row = df.agg(*(c.alias(k) for k, (c, _) in checks.items())).first()
    failed = {k: row[k] for k, (_, good) in checks.items() if not good(row[k])}
    if failed:
        raise QualityGateError(f"refused: {failed}")
    return df


def gate(found: DataFrame, strict: bool = True) -> DataFrame:
    """Raises on breaches if strict; returns them otherwise."""
    some = found.limit(20).collect()
    if strict and some:
        raise QualityGateError("; ".join(f"{r['metric']} {r['op']} {r['limit']}: {r['value']}" for r in some))
    return found


def guarded_ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(empty)).otherwise(part / whole)
