"""Sources. Every reader declares its schema; lines whose order matters are
numbered over the splits they are read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators.durability import durable
from ..operators.trees import depth_of, tree_paths

HARVEST = (
    "url string, id long, area string, slug string, name string, title string, description string, fontes string, ultima_atualizacao string, "
    "json_ld string, marker_windows map<string,array<string>>, question string, period_start string, period_end string, http_status int, bytes long, "
    "harvested_at string, sitemap_lastmod string, parse_warnings array<string>, error string, refetch_error string, refetch_failed_at string"
)
CATALOGUE = (
    "id long, area string, name string, name_en string, description string, fontes array<string>, ultima_atualizacao string, url string, harvested_at string, "
    "orgs array<string>, title string, breakdown string, unit string, revision string, question string, period string, removed boolean, featured array<string>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions table/v=<n>, in order."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(table)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): lines of text files, which are read in splits;
    (block, at) ascends in file order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return lines.select("file", "block", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) in file order, from 0. Lines are numbered within
    their split; how many come before it is known from one count a split."""
    lines = durable(ordered_lines(spark, path))
    blocks = sorted((r["file"], r["block"], r["count"]) for r in lines.groupBy("file", "block").count().collect())
    starts, now, total = [], None, 0
    for file, block, count in blocks:
        total = total if file == now else 0
        starts.append((file, block, total))
        now, total = file, total + count
    before = F.broadcast(spark.createDataFrame(starts, "file string, block long, before long"))
    local = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("local", local).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("local")).alias("line_no"), "line")


def url_list(spark: SparkSession, path: str, domain: str, sections: list[str]) -> DataFrame:
    """Entry pages of a list with one URL a line."""
    urls = spark.read.text(path).select(F.trim("value").alias("url"))
    return urls.where(U.is_listed_page(F.col("url"), domain, sections))


def commented_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines but blank ones and comments; a missing file is an empty list."""
    if not exists(spark, path):
        return spark.createDataFrame([], "url string")
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("url"))


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of a table split at the first tab; lastmod may be ""."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(parts[0].alias("url"), parts[1].alias("lastmod"))


def records(spark: SparkSession, path: str, schema: str = HARVEST) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a JSON-lines file: the last good line wins for each url;
    a line that does not parse or has no usable url is bad and kept for counting;
    blank lines are neither."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | (F.coalesce(F.trim("r.url"), F.lit("")) == "") | ~F.ltrim("line").startswith("{")
    good = parsed.where(~bad).groupBy("r.url").agg(F.max_by("r", F.struct("file", "line_no")).alias("r")).select("r.*").drop("_bad")
    return good, parsed.where(bad).select("line_no", "line")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that holds one object with a value for each key."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, escape='"')


def series_features(entries: DataFrame, title: str = "title") -> DataFrame:
    """Adds the matching features of a series title."""
    t = F.col(title)
    return entries.withColumns(
        {
            "e_tokens": T.content_words(t),
            "e_head": T.head_word(t),
            "e_derivation": T.derivation_markers(t),
            "e_units": T.unit_markers(T.trailing_unit(t)),
            "e_negations": T.negations(t),
        }
    )


def conforming(df: DataFrame, url: str, key: str, template: str) -> DataFrame:
    """``df`` if every URL is ``template`` with its key; raises otherwise, and
    on an empty table."""
    want = F.replace(F.lit(template), F.lit("{key}"), F.col(key))
    row = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(url), F.lit("")) != want).alias("bad")).first()
    if not row["n"] or row["bad"]:
        raise ValueError(f"{row['bad']} of {row['n']} URLs do not follow {template}")
    return df


def xml_records(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """Elements of an XML file, white space collapsed in every text."""
    reader = spark.read.format("xml").option("rowTag", tag)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select([T.collapse(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def sitemap(texts: DataFrame, column: str = "value") -> DataFrame:
    """(url, lastmod) of sitemap texts; bare locations where no url element has
    one."""
    body = F.col(column)
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<url>(.*?)</url>"), 1)
    loc = lambda b: F.trim(F.regexp_extract(b, r"(?s)<loc>\s*(.*?)\s*</loc>", 1))
    mod = lambda b: F.regexp_extract(b, r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1)
    full = F.filter(F.transform(blocks, lambda b: F.struct(loc(b).alias("url"), F.substring(mod(b), 1, 10).alias("lastmod"))), lambda s: s["url"] != "")
    bare = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.struct(T.unescape(u).alias("url"), F.lit("").alias("lastmod")))
    return texts.select(F.explode(F.when(F.size(full) > 0, full).otherwise(bare)).alias("s")).select("s.*")


def toc(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Data rows of an indented table of contents, each with its folder path.
    The header is checked; short rows are skipped; codes are upper-cased."""
    lines = numbered_lines(spark, path)
    first = lines.where("line_no = 0").select("line").first()
    found = [h.strip().strip('"') for h in (first["line"] if first else "").split("\t")]
    if found[: len(header)] != header:
        raise ValueError(f"unexpected header {found}")
    cells = lines.where("line_no > 0").withColumn("c", F.split("line", "\t")).where(F.size("c") >= len(header))
    plain = lambda k: F.btrim(F.col("c")[k], F.lit(' "'))
    title = F.regexp_replace(F.col("c")[0], '^"|"$', "")
    rows = cells.select("file", "line_no", depth_of(title).alias("depth"), F.trim(title).alias("title"), F.upper(plain(1)).alias("code"), plain(2).alias("type"), *(plain(k).alias(f"c{k}") for k in range(3, len(header))))
    return tree_paths(rows, "file", "line_no", "depth", "title", "type").where(F.col("type").isin("table", "dataset"))


def inventory(spark: SparkSession, path: str, key: str = "Code") -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True)
    return df.withColumn(key, F.upper(F.trim(key))).where(F.coalesce(F.col(key), F.lit("")) != "")


def snapshot(spark: SparkSession, path: str, date: str) -> DataFrame:
    """One version of a table partitioned by snapshot_date."""
    return spark.read.parquet(path).where(F.col("snapshot_date") == date).drop("snapshot_date")
