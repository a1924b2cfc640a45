"""Sinks. All go through Spark's writers and commit protocol, so they work on
any file system and survive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def replace_path(df: DataFrame, staged: str, final: str) -> None:
    """Renames a finished write into place. The old version is renamed aside
    first and deleted last, so a crash at any point loses neither: ``recover``
    puts it back where the new one did not get into place."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    src, dst, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, final, final + ".old"))
    fs = dst.getFileSystem(conf)
    recover(df.sparkSession, final)
    if fs.exists(dst) and not fs.rename(dst, old):
        raise OSError(f"could not move {final} aside")
    if not fs.rename(src, dst):
        recover(df.sparkSession, final)
        raise OSError(f"could not move {staged} to {final}")
    fs.delete(old, True)


def recover(spark: SparkSession, final: str) -> None:
    """Ends a replacement that was broken off: the version moved aside comes back
    where there is none, else it goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dst, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (final, final + ".old"))
    fs = dst.getFileSystem(conf)
    if fs.exists(old):
        if fs.exists(dst):
            fs.delete(old, True)
        elif not fs.rename(old, dst):
            raise OSError(f"could not move {final}.old back")


def sorted_json_lines(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in key order over all part files, replaced as a whole."""
    df.orderBy(key).write.mode("overwrite").json(path + ".next")
    replace_path(df, path + ".next", path)


def compact_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, fields without a value left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def flat(df: DataFrame, sep: str = " | ") -> DataFrame:
    """Lists joined, booleans as yes or "": what a flat file can hold."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.coalesce(F.array_join(c.cast("array<string>"), sep), F.lit(""))
        elif kind == "boolean":
            c = F.when(c, "yes").otherwise("")
        out.append(c.alias(name))
    return df.select(out)


def flat_csv(df: DataFrame, path: str, sep: str = " | ", compression: str = "none") -> None:
    flat(df, sep).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_changed(df: DataFrame, manifest: DataFrame | None, key: str, content: Column, path: str) -> DataFrame:
    """Appends the rows whose content changed; returns the new manifest rows
    (key, sha)."""
    hashed = df.withColumn("sha", F.sha2(content, 256))
    changed = hashed if manifest is None else hashed.join(manifest.select(key, "sha"), [key, "sha"], "left_anti")
    changed.write.mode("append").parquet(path)
    return changed.select(key, "sha")


def name_status(name: Column, other: Column) -> Column:
    a, b = F.coalesce(name, F.lit("")) != "", F.coalesce(other, F.lit("")) != ""
    return F.when(a & b, "ok").when(a, "missing_en").when(b, "missing_pt").otherwise("missing_both")


def page_document(title: Column, body: Column, version: Column) -> Column:
    """A page for each row."""
    return F.concat(F.lit("<!doctype html><title>"), T.escape_html(title), F.lit('</title><meta name="version" content="'), version, F.lit('"><main>'), T.escape_html(body), F.lit("</main>"))


def sitemap_document(df: DataFrame, url: str, updated: str, per_file: int = 50_000) -> DataFrame:
    """Sitemap texts of at most ``per_file`` entries; a date only where it is
    one."""
    mod = F.when(F.col(updated).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("<lastmod>"), F.col(updated), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), T.escape_html(F.col(url)), F.lit("</loc>"), mod, F.lit("</url>"))
    parts = max(1, -(-df.count() // per_file))
    part = F.pmod(F.xxhash64(url), F.lit(parts))
    bodies = df.groupBy(part.alias("part")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("b"))
    return bodies.select("part", F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("value"))


def dataset_descriptor(fields: dict[str, Column]) -> Column:
    """Linked data of a row, members without a value left out, safe in a script
    element."""
    body = F.to_json(F.struct(*(F.nullif(c, F.lit("")).alias(k) for k, c in fields.items())))
    for plain, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        body = F.replace(body, F.lit(plain), F.lit(code))
    return body


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A report table of at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def clamped(c: Column, most: int = 60_000, notice: str = "\n\n_(output truncated to fit)_\n") -> Column:
    """A text that a sink with a size limit takes: cut to ``most`` characters,
    notice included."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, F.lit(1), F.lit(most - len(notice))), F.lit(notice))).otherwise(c)
