"""Keyed tables: upserts, snapshot differences, work plans, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from .durability import durable


def keep_one(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key in ``order``; as an aggregate, so that a hot key
    is combined before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*").select(df.columns)


def keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last occurrence wins (position must be unique within a key)."""
    return keep_one(df, keys, -F.col(position))


def keep_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return keep_one(df, keys, F.col(position))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def collapse_agreeing(df: DataFrame, key: str, collect: str, others: list[str]) -> DataFrame:
    """One row a key: ``collect``'s distinct values, sorted, their number, and
    whether all other fields agree."""
    return df.groupBy(key).agg(
        F.array_sort(F.collect_set(collect)).alias(f"{collect}s"),
        F.count_distinct(collect).alias(f"{collect}_count"),
        *(F.min(c).alias(c) for c in others),
        (F.count_distinct(F.struct(*others)) == 1).alias("agrees"),
    )


def require_agreement(collapsed: DataFrame) -> DataFrame:
    bad = collapsed.where("NOT agrees").limit(5).collect()
    if bad:
        raise ValueError(f"rows of one key disagree: {[r[0] for r in bad]}")
    return collapsed.drop("agrees")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, stamp: str, may_update: Column | None = None) -> DataFrame:
    """(key, kind, old_stamp, new_stamp): added, removed, and updated where the
    stamp moved and ``may_update`` holds. One full outer join."""
    o = old.select(key, F.col(stamp).alias("old_stamp"), F.lit(True).alias("was"))
    n = new.select(key, F.col(stamp).alias("new_stamp"), F.lit(True).alias("is"))
    moved = ~F.col("old_stamp").eqNullSafe(F.col("new_stamp"))
    if may_update is not None:
        moved = moved & may_update
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(moved, "updated")
    return o.join(n, key, "full_outer").withColumn("kind", kind).where("kind IS NOT NULL").select(key, "kind", "old_stamp", "new_stamp")


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, stamp: str, may_update: Column | None = None) -> DataFrame:
    """``snapshot_diff`` with the rules of a first run: without an old snapshot
    there is no difference, only a baseline; without old stamps nothing counts as
    updated."""
    had = old.agg((F.count(key) > 0).alias("__keys"), (F.count(stamp) > 0).alias("__stamps"))  # one row
    found = snapshot_diff(old, new, key, stamp, may_update).join(F.broadcast(had), F.lit(True))
    return found.where(F.col("__keys") & (F.col("__stamps") | (F.col("kind") != "updated"))).drop("__keys", "__stamps")


def change_report(changes: DataFrame, key: str, listed: int = 50, mass: int = 200) -> DataFrame:
    """(kind, n, listed, more, mass_churn): how many changes of each kind, the
    first ``listed`` keys, how many there are beyond; over ``mass`` updates are
    wholesale churn and none is listed."""
    # each task keeps the smallest keys only
    part = changes.groupBy("kind", F.pmod(F.xxhash64(key), F.lit(64)).alias("p")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(key)), 1, listed).alias("few"))
    whole = part.groupBy("kind").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, listed).alias("few"))
    churn = (F.col("kind") == "updated") & (F.col("n") > mass)
    shown = F.array_join(F.transform("few", lambda x: x.cast("string")), ",")
    return whole.select("kind", "n", F.when(churn, "").otherwise(shown).alias("listed"), F.greatest(F.col("n") - listed, F.lit(0)).alias("more"), churn.alias("mass_churn"))


def merge_owned(current: DataFrame, fetched: DataFrame, owned: Column) -> DataFrame:
    """Rows of keys that the fetcher owns come from ``fetched``, all others from
    ``current``: what somebody else put there stays."""
    return current.where(~owned).unionByName(fetched.where(owned))


def one_a_day(log: DataFrame, day: str, taken: DataFrame, most: int) -> DataFrame:
    """Days of ``log`` that have no entry in ``taken`` yet, each once, the latest
    ``most`` of them."""
    return log.select(day).where(F.col(day).isNotNull()).distinct().join(taken.select(day), day, "left_anti").orderBy(F.desc(day)).limit(most)


def work_plan(targets: DataFrame, records: DataFrame, stamps: DataFrame, abandoned: DataFrame, key: str) -> DataFrame:
    """(key, reason): missing, then errored, then stale targets, without the
    abandoned ones. ``records`` has error, harvested_at, stored_stamp;
    ``stamps`` has stamp."""
    t = targets.select(key).distinct().join(abandoned.select(key), key, "left_anti")
    j = t.join(records.select(key, "error", "harvested_at", "stored_stamp", F.lit(True).alias("known")), key, "left").join(stamps.select(key, "stamp"), key, "left")
    stale = D.is_stale(F.col("harvested_at"), F.col("stored_stamp"), F.col("stamp"))
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("error").isNotNull(), "errored").when(stale, "stale")
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select(key, "reason")


def with_tombstones(records: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Every record, with removed set where no target names it any more."""
    live = targets.select(key).distinct().withColumn("live", F.lit(True))
    return records.join(live, key, "left").withColumn("removed", F.col("live").isNull()).drop("live")


def merge_later_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union by key; rows of ``second`` replace those of ``first``."""
    both = first.withColumn("__p", F.lit(1)).unionByName(second.withColumn("__p", F.lit(0)))
    return keep_one(both, [key], F.col("__p")).drop("__p")


def upsert_keep_good(current: DataFrame, incoming: DataFrame, key: str, error: str = "error") -> DataFrame:
    """Incoming rows replace current ones, but a failed fetch never replaces a
    good record: that keeps its values and gains refetch_error."""
    c = current.select(key, F.struct(*current.columns).alias("c"))
    i = incoming.select(key, F.struct(*incoming.columns).alias("i"))
    j = c.join(i, key, "full_outer")
    keep = F.col("c").isNotNull() & F.col(f"c.{error}").isNull() & (F.col("i").isNull() | F.col(f"i.{error}").isNotNull())
    rest = [F.when(keep, F.col(f"c.{x}")).otherwise(F.coalesce(F.col(f"i.{x}"), F.when(F.col("i").isNull(), F.col(f"c.{x}")))).alias(x) for x in current.columns if x != key]
    return j.select(key, *rest, F.when(keep, F.col(f"i.{error}")).alias("refetch_error"))


def changed_rows(df: DataFrame, manifest: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows whose content hash the manifest (key, sha) does not have."""
    hashed = df.withColumn("sha", F.sha2(content, 256))
    return hashed.join(manifest.select(key, "sha"), [key, "sha"], "left_anti")


def numbered(df: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """``df`` with row numbers in ``order``. Rows are numbered within ranges, so
    no single task sorts all of them; the ranges are written first, as two plans
    of one range partitioning may cut it differently."""
    spark = df.sparkSession
    ranged = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}  # one row a range
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    if not starts:
        return df.limit(0).withColumn(name, F.lit(0).cast("long"))
    before = F.broadcast(spark.createDataFrame(starts, "__part int, __before long"))
    local = Window.partitionBy("__part").orderBy(*order)
    return ranged.join(before, "__part").withColumn(name, F.row_number().over(local) + F.col("__before")).drop("__part", "__before")


def systematic_sample(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Every floor(n / size)-th row in order, the first ``size`` of them."""
    step = max(1, df.count() // size)
    wanted = ((F.col("rn") - 1) % step == 0) & (F.floor((F.col("rn") - 1) / step) < size)
    return numbered(df, order).where(wanted)


def quota_sample(df: DataFrame, stratum: str, order: list[Column], quota: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("rn") <= quota)
