"""Queries of keyed tables: upserts, joins, snapshot differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import keyed as K
from .base import query


@query("q20_keep_last", "SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS body FROM conversations GROUP BY 1")
def keep_last(t):
    return K.keep_last(t.conversations.select("conv_id", "turn", "role", F.md5("text").alias("body")), ["conv_id"], "turn")


@query("q21_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def keep_first(t):
    return K.keep_first(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("q23_duplicate_keys", "SELECT md5(text) AS body, lang, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1")
def duplicate_keys(t):
    return K.duplicate_keys(t.documents.select(F.md5("text").alias("body"), "lang"), ["body", "lang"])


SNAPSHOTS = """
    o AS (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS stamp FROM customer WHERE c_custkey % 7 <> 0),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS stamp FROM customer WHERE c_custkey % 11 <> 0),
    d AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.stamp IS DISTINCT FROM n.stamp AND o.c_custkey % 2 = 0 THEN 'updated' END AS kind,
      o.stamp AS old_stamp, n.stamp AS new_stamp FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
"""


def _snapshots(t):
    key = F.col("c_custkey")
    old = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", F.when(key % 13 != 0, F.col("c_mktsegment")).alias("stamp"))
    new = t.customer.where("c_custkey % 11 <> 0").select("c_custkey", F.when(key % 5 == 0, "MOVED").when(key % 17 != 0, F.col("c_mktsegment")).alias("stamp"))
    return old, new


@query("q41_snapshot_diff", f"WITH {SNAPSHOTS} SELECT * FROM d WHERE kind IS NOT NULL")
def snapshot_diff(t):
    return K.snapshot_diff(*_snapshots(t), "c_custkey", "stamp", F.col("c_custkey") % 2 == 0)


@query(
    "q113_change_report",
    f"""
    WITH {SNAPSHOTS}, r AS (SELECT 'all' AS run, c_custkey, kind FROM d WHERE kind IS NOT NULL UNION ALL SELECT 'no stamps', c_custkey, kind FROM d WHERE kind IN ('added', 'removed')),
    g AS (SELECT run, kind, count(*) AS n, array_to_string(list_sort(list(c_custkey))[1:50], ',') AS few FROM r GROUP BY 1, 2)
    SELECT run, kind, n, CASE WHEN kind = 'updated' AND n > 20 THEN '' ELSE few END AS listed, greatest(n - 50, 0) AS more, kind = 'updated' AND n > 20 AS mass_churn FROM g
    """,
)
def change_report(t):
    """A run with both snapshots, one without old stamps (nothing counts as
    updated), and a first one (no difference at all)."""
    old, new = _snapshots(t)
    runs = {"all": old, "no stamps": old.withColumn("stamp", F.lit(None).cast("string")), "first": old.limit(0)}
    out = None
    for run, before in runs.items():
        changes = K.snapshot_changes(before, new, "c_custkey", "stamp", F.col("c_custkey") % 2 == 0)
        one = K.change_report(changes, "c_custkey", mass=20).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "q117_owned_keys",
    "SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN upper(c_name) ELSE c_name END AS value FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 <> 0",
)
def owned_keys(t):
    """A fetcher owns every fourth key: its rows replace those, or drop them where
    it has none; the others' stay."""
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    own = F.col("c_custkey") % 4 == 0
    current = t.customer.select(key.alias("key"), F.col("c_name").alias("value"), own.alias("own"))
    fetched = t.customer.where("c_custkey % 3 <> 0").select(key.alias("key"), F.upper("c_name").alias("value"), own.alias("own"))
    return K.merge_owned(current, fetched, F.col("own")).drop("own")


@query(
    "q118_one_a_day",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49) ORDER BY 1 DESC LIMIT 40",
)
def one_a_day(t):
    taken = t.lineitem.where("l_quantity > 49").select(F.col("l_shipdate").cast("date").alias("day"))
    return K.one_a_day(t.orders.select(F.col("o_orderdate").cast("date").alias("day")), "day", taken, 40)


@query(
    "q42_work_plan",
    """
    WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0),
    r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS error, strftime(o_orderdate, '%Y-%m-%d') AS h,
      CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN '' END AS s FROM orders WHERE o_orderkey % 10 <> 0),
    l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate + to_days(CAST(o_orderkey % 5 - 2 AS INT)), '%Y-%m-%d') END AS n FROM orders),
    j AS (SELECT t.o_orderkey, r.o_orderkey AS known, error, h, nullif(s, '') AS s, nullif(n, '') AS n FROM t LEFT JOIN r USING (o_orderkey) LEFT JOIN l USING (o_orderkey)),
    k AS (SELECT o_orderkey, CASE WHEN known IS NULL THEN 'missing' WHEN error IS NOT NULL THEN 'errored' WHEN n IS NULL THEN NULL WHEN s IS NOT NULL AND s <> n THEN 'stale' WHEN s IS NULL AND n > h THEN 'stale' END AS reason FROM j)
    SELECT * FROM k WHERE reason IS NOT NULL
    """,
)
def work_plan(t):
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    records = t.orders.where("o_orderkey % 10 <> 0").select(
        "o_orderkey", F.when(key % 17 == 0, "timeout").alias("error"), iso(day).alias("harvested_at"), F.when(key % 3 == 0, iso(F.date_sub(day, 1))).when(key % 3 == 1, "").alias("stored_stamp")
    )
    stamps = t.orders.select("o_orderkey", F.when(key % 4 == 0, "").otherwise(iso(F.date_add(day, (key % 5 - 2).cast("int")))).alias("stamp"))
    abandoned = t.orders.where("o_orderkey % 13 = 0").select("o_orderkey")
    return K.work_plan(t.orders.select("o_orderkey"), records, stamps, abandoned, "o_orderkey")


@query("q43_tombstones", "SELECT p_partkey, p_name, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS removed FROM part")
def tombstones(t):
    live = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return K.with_tombstones(t.part.select("p_partkey", "p_name"), live, "p_partkey")


@query(
    "q44_keyed_merge",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0",
)
def keyed_merge(t):
    own = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return K.merge_later_wins(own, t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name")), "c_custkey")


@query("q74_dim_enrich", "SELECT c_custkey, n_name, coalesce(CASE WHEN r_regionkey <> 1 THEN r_name END, '') AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_enrich(t):
    regions = t.region.where("r_regionkey <> 1")
    dim = t.nation.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    # 25 nations: a dimension of fixed size
    j = t.customer.select("c_custkey", "c_nationkey").join(F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("c_custkey", "n_name", F.coalesce("r_name", F.lit("")).alias("r_name"))


@query(
    "q75_composite_key_join",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, q, d FROM a LEFT JOIN b USING (l_orderkey, l_linenumber)
    """,
)
def composite_key_join(t):
    keys = ["l_orderkey", "l_linenumber"]
    a = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    return a.join(t.lineitem.where("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_discount").alias("d")), keys, "left")


@query(
    "q76_array_lookup",
    """
    SELECT l_orderkey, string_agg(CASE WHEN p_size > 25 THEN p_name ELSE CAST(l_partkey AS VARCHAR) END, '|' ORDER BY l_linenumber, l_partkey) AS names
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def array_lookup(t):
    names = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    spread = lists.select("l_orderkey", F.posexplode("x").alias("pos", "s")).select("l_orderkey", "pos", "s.l_partkey")
    label = F.coalesce("p_name", F.col("l_partkey").cast("string"))
    back = spread.join(names, "l_partkey", "left").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", label.alias("n")))).alias("y"))
    return back.select("l_orderkey", F.array_join(F.transform("y", lambda s: s["n"]), "|").alias("names"))


@query("q77_missing_outputs", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def missing_outputs(t):
    return t.part.select("p_partkey").join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query(
    "q78_refetchable_share",
    """
    WITH l AS (SELECT l_orderkey, max(l_shipdate::DATE) AS d FROM lineitem GROUP BY 1)
    SELECT o_orderpriority, round_even(avg(CASE WHEN date_diff('day', d, DATE '2000-06-30') <= 365 AND d IS NOT NULL THEN 1.0 ELSE 0.0 END), 3) AS share FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1
    """,
)
def refetchable_share(t):
    l = t.lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("d"))
    j = t.orders.select("o_orderkey", "o_orderpriority").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fresh = F.coalesce(F.datediff(F.lit("2000-06-30").cast("date"), F.col("d")) <= 365, F.lit(False))
    return j.groupBy("o_orderpriority").agg(F.bround(F.avg(F.when(fresh, 1.0).otherwise(0.0)), 3).alias("share"))


@query("q68_changed_manifest", "SELECT page_id, sha256(html) AS sha, left(sha256(html), 8) AS version FROM pages WHERE page_id % 3 <> 0 OR page_id % 2 = 0")
def changed_manifest(t):
    from ..functions.hashing import version

    manifest = t.pages.where("page_id % 3 = 0").select("page_id", F.when(F.col("page_id") % 2 == 0, "old").otherwise(F.sha2("html", 256)).alias("sha"))
    return K.changed_rows(t.pages.select("page_id", "html"), manifest, "page_id", F.col("html")).select("page_id", "sha", version(F.col("html")).alias("version"))


@query("q102_repair_changed", "SELECT doc_id, trim(source || ', ' || lang) AS repaired, doc_id % 2 = 0 AS changed FROM documents")
def repair_changed(t):
    from ..functions.text import clean_sources

    raw = F.concat_ws(", ", "source", "lang")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(raw, F.lit(" | Carregue aqui para ver"))).otherwise(raw)
    x = t.documents.select("doc_id", raw.alias("raw")).withColumn("repaired", clean_sources(F.col("raw")))
    return x.select("doc_id", "repaired", (F.col("repaired") != F.col("raw")).alias("changed"))


@query(
    "q103_upsert_keep_good",
    """
    WITH c AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'old' END AS error FROM customer WHERE c_custkey % 5 <> 0),
    i AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN upper(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' END AS error FROM customer WHERE c_custkey % 7 <> 0),
    j AS (SELECT c_custkey, c.c_custkey IS NOT NULL AS hc, i.c_custkey IS NOT NULL AS hi, c.name AS cn, c.error AS ce, i.name AS n, i.error AS ie FROM c FULL JOIN i USING (c_custkey)),
    k AS (SELECT *, hc AND ce IS NULL AND (NOT hi OR ie IS NOT NULL) AS keep FROM j)
    SELECT c_custkey, CASE WHEN keep OR NOT hi THEN cn ELSE n END AS name, CASE WHEN keep OR NOT hi THEN ce ELSE ie END AS error, CASE WHEN keep THEN ie END AS refetch_error FROM k
    """,
)
def upsert_keep_good(t):
    key = F.col("c_custkey")
    current = t.customer.where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_name").alias("name"), F.when(key % 4 == 0, "old").alias("error"))
    incoming = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", F.when(key % 3 != 0, F.upper("c_name")).alias("name"), F.when(key % 3 == 0, "new").alias("error"))
    return K.upsert_keep_good(current, incoming, "c_custkey")


@query("q105_comment_list", "SELECT 'https://h/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-01' ELSE '' END AS lastmod FROM part WHERE p_partkey % 3 = 0")
def comment_list(t):
    k = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  # "), k)).when(F.col("p_partkey") % 3 == 2, "  ").otherwise(F.concat(F.lit("https://h/"), k, F.lit("\t"), F.when(F.col("p_partkey") % 2 == 0, "2024-01-01").otherwise("")))
    kept = t.part.select(F.rtrim(line).alias("rough"), line.alias("line")).where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    parts = F.split("line", "\t", 2)
    return kept.select(parts[0].alias("url"), parts[1].alias("lastmod"))
