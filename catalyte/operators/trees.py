"""Indented listings: paths from a running folder stack, without a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 12


def tree_paths(rows: DataFrame, group: str, position: str, depth: str, name: str, kind: str, folder: str = "folder", deepest: int = MAX_DEPTH) -> DataFrame:
    """Adds path: the folder stack at each row, joined by " / ", the root
    dropped if there is more. Folder rows truncate the stack at their depth;
    leaves take it as it stands, whatever their own depth."""
    before = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    is_folder = F.col(kind) == folder
    out = rows.withColumn("__d", F.last(F.when(is_folder, F.col(depth)), ignorenulls=True).over(before))
    for level in range(deepest):
        out = out.withColumn(f"__l{level}", F.last(F.when(is_folder & (F.col(depth) == level), F.col(name)), ignorenulls=True).over(before))
    stack = F.array_compact(F.array(*(F.when(F.col("__d") >= level, F.col(f"__l{level}")) for level in range(deepest))))
    path = F.when(F.size(stack) > 1, F.slice(stack, F.lit(2), F.size(stack) - 1)).otherwise(stack)
    return out.withColumn("path", F.array_join(path, " / ")).drop("__d", *(f"__l{level}" for level in range(deepest)))


def depth_of(line, indent: int = 4):
    return ((F.length(line) - F.length(F.ltrim(line))) / indent).cast("int")
