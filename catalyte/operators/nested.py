"""Key paths of nested JSON: what a response holds, without its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names a value, and what a quoted number looks like.
VALUE_LIKE = r"(?i)valor|value|dim_|geo|dsg|ano|periodo"
QUOTED_NUMBER = r'"\d+[.,]?\d*"'
DEPTH = 6


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, null or number."""
    schema = F.schema_of_variant(value)
    known = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))
    return reduce(lambda rest, pair: F.when(schema.startswith(pair[0]), pair[1]).otherwise(rest), known, F.lit("number"))


def key_paths(df: DataFrame, key: str, json: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, kind) of every member of the JSON objects in ``json``, down to
    ``depth`` levels below the top; of an array the first element stands for all.
    Text that does not parse has none. One lateral join a level, in the JVM."""
    tvf = df.sparkSession.tvf
    now, found = df.select(F.col(key).alias("row"), F.lit("").alias("prefix"), F.try_parse_json(F.col(json)).alias("v")).where("v IS NOT NULL"), []
    for _ in range(depth + 1):
        inner = now.lateralJoin(tvf.variant_explode(F.col("v").outer())).where(F.col("key").isNotNull() | (F.col("pos") == 0))
        dotted = F.when(F.col("prefix") == "", F.col("key")).otherwise(F.concat("prefix", F.lit("."), "key"))
        spread = inner.select("row", F.coalesce(dotted, F.concat("prefix", F.lit("[]"))).alias("prefix"), F.col("value").alias("v"), F.col("key").isNotNull().alias("named"))
        found.append(spread.where("named").select("row", F.col("prefix").alias("path"), kind_of(F.col("v")).alias("kind")))
        now = spread.select("row", "prefix", "v")
    return reduce(DataFrame.union, found).withColumnRenamed("row", key)


def response_profile(df: DataFrame, key: str, json: str, shown: int = 20) -> DataFrame:
    """One row a response: key, how many paths and quoted numbers it has, and the
    first paths that name values."""
    like = F.when(F.col("path").rlike(VALUE_LIKE), F.col("path"))
    paths = key_paths(df, key, json).groupBy(key).agg(F.count("*").alias("key_count"), F.array_join(F.slice(F.array_sort(F.collect_set(like)), 1, shown), ",").alias("value_like_keys"))
    numbers = df.select(key, F.regexp_count(json, F.lit(QUOTED_NUMBER)).alias("numbers"))
    return numbers.join(paths, key, "left").select(key, "numbers", F.coalesce("key_count", F.lit(0)).alias("key_count"), F.coalesce("value_like_keys", F.lit("")).alias("value_like_keys"))
