"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed over (source, lang, topic) cells; the cells are raked
until their sums meet the target shares of every source, language and topic;
each document is then kept with a probability in proportion to its cell's
factor, decided by a hash of its id.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name

AXES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse kind of content, read off the whole text: where a table has no
    topic column of its own."""
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(bars * 40 > n, "table")
        .when(digits * 20 > n, "figures")
        .when(lines * 60 > n, "list")
        .otherwise("prose")
    )


def tempered(observed: dict[str, float], blend: float = 0.2, boost: float = 1.1) -> dict[str, float]:
    """Target shares: the observed ones, drawn by ``blend`` towards equal ones,
    but none beyond ``boost`` times its own, so that small values do not decide
    how much of the rest can stay."""
    total, n = sum(observed.values()), len(observed)
    drawn = {k: min((1 - blend) * v / total + blend / n, boost * v / total) for k, v in observed.items()}
    whole = sum(drawn.values())
    return {k: v / whole for k, v in drawn.items()}


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Factor of each cell (columns source, lang, topic, tokens) after iterative
    proportional fitting; targets are shares of the total. Values without tokens
    keep factor 1; a target no cell can meet is warned of."""
    weight = cells["tokens"].to_numpy(np.float64).copy()
    total = weight.sum()
    if not total:
        return np.ones(len(cells))
    axes = []
    for axis in AXES:
        names, codes = np.unique(cells[axis].to_numpy(), return_inverse=True)
        share = np.array([targets[axis].get(k, 0.0) for k in names])
        axes.append((codes, len(names), share / share.sum() * total))
    for _ in range(rounds):
        worst = 0.0
        for codes, n, want in axes:
            have = np.bincount(codes, weight, n)
            ratio = np.divide(want, have, out=np.ones(n), where=have > 0)
            worst = max(worst, float(np.abs(ratio - 1).max()))
            weight = weight * ratio[codes]
        if worst < tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds, {worst:.2g} off a target", stacklevel=2)
    tokens = cells["tokens"].to_numpy(np.float64)
    return np.divide(weight, tokens, out=np.ones(len(tokens)), where=tokens > 0)


def _rows(docs: DataFrame) -> list[Column]:
    """Source, language, topic and tokens of a row."""
    text = F.col("text").cast("string")
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text)
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic.alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"),
    ]


def calibrate(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, blend: float = 0.2, rate: float = 1.0, driver_cells: int = 2_000_000) -> DataFrame:
    """(source, lang, topic, factor, probability) of every cell of ``rows``. Up to
    ``driver_cells`` cells, which are counted first, are raked on the driver, more
    in Spark: the same steps."""
    cells = durable(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")))
    if cells.count() > driver_cells:
        return _calibrate_far(cells, targets or {}, blend, rate)
    found = cells.toPandas().sort_values(list(AXES)).reset_index(drop=True)
    some = len(found) and found["tokens"].sum()
    goal = {axis: (targets or {}).get(axis) or tempered(found.groupby(axis)["tokens"].sum().astype(float).to_dict(), blend) if some else {} for axis in AXES}
    found["factor"] = rake(found, goal)
    most = float(found["factor"].max()) if len(found) else 1.0
    found["probability"] = found["factor"] / most * rate if most else 0.0
    schema = "source string, lang string, topic string, factor double, probability double"
    table = rows.sparkSession.createDataFrame(found[[*AXES, "factor", "probability"]].values.tolist(), schema)
    return F.broadcast(table) if len(found) <= 100_000 else table


def _calibrate_far(cells: DataFrame, targets: dict[str, dict[str, float]], blend: float, rate: float, boost: float = 1.1, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``calibrate`` over more cells than the driver takes."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double")).first()[0]
    shares = {}
    for axis in AXES:
        observed = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("have"))
        if axis in targets:
            share = spark.createDataFrame(list(targets[axis].items()), f"`{axis}` string, share double")
            share = observed.join(share, axis, "left").select(axis, F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            n = observed.count()
            drawn_to = F.least((1 - blend) * F.col("have") / total + blend / n, boost * F.col("have") / total)
            share = observed.select(axis, drawn_to.alias("share"))
        whole = share.agg(F.sum("share")).first()[0]
        shares[axis] = durable(share.select(axis, (F.col("share") / whole * total).alias("want")))
    now = durable(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        worst = 0.0
        for axis in AXES:
            ratio = durable(now.groupBy(axis).agg(F.sum("weight").alias("have")).join(shares[axis], axis).select(axis, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("ratio")))
            worst = max(worst, ratio.agg(F.max(F.abs(F.col("ratio") - 1))).first()[0])
            now = durable(now.join(ratio, axis).withColumn("weight", F.col("weight") * F.col("ratio")).drop("ratio"))
        if worst < tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds, {worst:.2g} off a target", stacklevel=2)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    out = now.select(*AXES, factor.alias("factor"))
    most = out.agg(F.max("factor")).first()[0]
    return out.withColumn("probability", F.col("factor") / most * rate if most else F.lit(0.0))


def drawn(seed: int, probability: str = "probability") -> Column:
    """Whether a row is in the sample: a hash of its id against its probability."""
    unit = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    return unit < F.col(probability)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, blend: float = 0.2, rate: float = 1.0, seed: int = 7, driver_cells: int = 2_000_000) -> DataFrame:
    """Every document with its calibrated sampling decision: doc_id, source,
    lang, topic, n_tokens, factor, probability, sampled.

    Tokens are white-space separated words of the whole text. ``targets`` gives
    shares by axis; an axis left out is drawn by ``blend`` towards equal shares.
    The largest factor is kept with probability ``rate``, the others in
    proportion, so the expected token shares of the sample meet the targets.
    Null source or lang is the value "" of its axis; null and empty texts have
    the topic "empty", no tokens, and factor 1 if their cell has none; equal rows
    have equal decisions; an empty table gives no rows. A column named topic is
    used as the topic; others are ignored. Targets that contradict each other are
    met as far as ``rake`` comes, with a warning.
    """
    rows = durable(docs.select(F.col("doc_id").cast("long"), *_rows(docs)))  # the texts are read once
    joined = rows.join(calibrate(rows, targets, blend, rate, driver_cells), list(AXES))
    return joined.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 9).alias("factor"), F.round("probability", 9).alias("probability"), drawn(seed).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, blend: float = 0.2, rate: float = 1.0, seed: int = 7, driver_cells: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, all columns as they are."""
    source, lang, topic, _ = _rows(docs)
    cells = calibrate(docs.select(*_rows(docs)), targets, blend, rate, driver_cells)
    names = {c: free_name(f"cell_{c}", docs.columns) for c in (*AXES, "probability")}
    cells = cells.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = (source == F.col(names["source"])) & (lang == F.col(names["lang"])) & (topic == F.col(names["topic"]))
    return docs.join(cells, same).where(drawn(seed, names["probability"])).select(*(docs[f"`{c}`"] for c in docs.columns))
