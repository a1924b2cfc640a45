"""Queries of the aggregations, windows and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keyed as K
from ..operators import nested as N
from ..operators import linkage as L
from ..operators import pages as P
from ..operators import quality as Q
from ..operators.trees import tree_paths
from .base import query


@query(
    "q22_coverage_rollup",
    """
    SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round_even(coalesce(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 0), 4) AS labelled,
      round_even(coalesce(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END), 0), 4) AS with_text
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())
    """,
)
def coverage_rollup(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    return Q.coverage_by(j, "lang", {"labelled": F.col("quality").isNotNull(), "with_text": T.present(F.col("text"))})


@query("q24_distinct_elements", "WITH w AS (SELECT lang, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS w FROM documents) SELECT lang, count(DISTINCT w) AS words FROM w WHERE w <> '' GROUP BY lang")
def distinct_elements(t):
    w = t.documents.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).where("w <> ''")
    return w.distinct().groupBy("lang").agg(F.count("*").alias("words"))


@query(
    "q25_mode_share",
    """
    WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS p FROM documents GROUP BY 1, 2), m AS (SELECT source, arg_max(lang, n * 100000000 - p) AS v, max(n) AS n, sum(n) AS total FROM c GROUP BY 1)
    SELECT source, CASE WHEN n / total >= 0.5 THEN v END AS lang, round_even(CAST(n AS DOUBLE) / total, 3) AS lang_share FROM m
    """,
)
def mode_share(t):
    return L.mode_share(t.documents.select("source", F.col("lang").alias("l"), "doc_id"), ["source"], "l", "doc_id", "lang")


@query(
    "q26_medians",
    """
    WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT p, CAST(coalesce(median(n), 0) AS DOUBLE) AS median, list_sort(list(n))[len(list(n)) // 2 + 1] AS upper_median, max(n) AS most, min(n) AS least, round_even(avg(n), 4) AS mean, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n = 1) AS singles FROM c GROUP BY p
    """,
)
def medians(t):
    c = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    # the upper median without a list: the discrete percentile just past a half
    ranked = c.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("n", "o_custkey"))).withColumn("all", F.count("*").over(Window.partitionBy("p")))
    upper = F.max(F.when(F.col("rn") == F.floor(F.col("all") / 2) + 1, F.col("n")))
    return ranked.groupBy("p").agg(
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median"), upper.alias("upper_median"), F.max("n").alias("most"), F.min("n").alias("least"), F.bround(F.avg("n"), 4).alias("mean"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("singles")
    )


@query(
    "q27_histogram",
    "SELECT CAST(len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= least(l_discount * 10, 0.999::DOUBLE))) - 1 AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
)
def histogram(t):
    share = F.least(F.col("l_discount") * 10, F.lit(0.999))
    edges = [k / 10 for k in range(10)] + [1.01]
    bin_of = F.lit(None).cast("int")
    for k in range(10):
        bin_of = F.when((share >= edges[k]) & (share < edges[k + 1]), F.lit(k)).otherwise(bin_of)
    return t.lineitem.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


@query("q28_sorted_sets", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_name)))[1:10], '|') AS names, array_to_string(list_sort(list_distinct(list(p_type)))[1:6], '|') AS types FROM part GROUP BY 1")
def sorted_sets(t):
    some = lambda c, n: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), "|")
    return t.part.groupBy("p_brand").agg(some("p_name", 10).alias("names"), some("p_type", 6).alias("types"))


@query(
    "q29_ranked_prefix",
    """
    WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
    SELECT l_partkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY rn) AS orders, any_value(n) AS n, any_value(n) > 25 AS truncated FROM r WHERE rn <= 25 GROUP BY 1
    """,
)
def ranked_prefix(t):
    order = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    kept = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity").withColumn("rn", F.row_number().over(order)).where("rn <= 25")
    sizes = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_orderkey"))), lambda s: s["l_orderkey"].cast("string"))
    return kept.groupBy("l_partkey").agg(F.array_join(listed, ",").alias("orders")).join(sizes, "l_partkey").select("l_partkey", "orders", "n", (F.col("n") > 25).alias("truncated"))


@query(
    "q30_status_map",
    """
    WITH j AS (SELECT CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE d.lang END AS a, CAST(l.quality AS VARCHAR) AS b FROM documents d FULL JOIN labels l USING (doc_id))
    SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'ok' WHEN a IS NOT NULL THEN 'missing_en' WHEN b IS NOT NULL THEN 'missing_pt' ELSE 'missing_both' END AS status, count(*) AS n FROM j GROUP BY 1
    """,
)
def status_map(t):
    from ..sources.writers import name_status

    a = F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("lang"))
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "full_outer")
    return j.groupBy(name_status(a, F.col("quality").cast("string")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "q31_weekday_hits",
    """
    SELECT strftime(ts, '%a') AS day, CAST(isodow(ts) AS INT) AS place, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2
    """,
)
def weekday_hits(t):
    place = F.expr("weekday(ts) + 1")
    return t.events.groupBy(F.date_format("ts", "EEE").alias("day"), place.alias("place")).agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(
    "q32_collapse_agree",
    """
    SELECT p_name, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS themes, count(DISTINCT p_type) AS theme_count, min(p_brand) AS brand, count(DISTINCT p_brand) = 1 AS agrees FROM part GROUP BY 1
    """,
)
def collapse_agree(t):
    c = K.collapse_agreeing(t.part, "p_name", "p_type", ["p_brand"])
    return c.select("p_name", F.array_join("p_types", "|").alias("themes"), F.col("p_type_count").alias("theme_count"), F.col("p_brand").alias("brand"), "agrees")


@query(
    "q36_systematic_sample",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, rn FROM r WHERE (rn - 1) % greatest(1, n // 40) = 0 AND (rn - 1) // greatest(1, n // 40) < 40
    """,
)
def systematic_sample(t):
    return K.systematic_sample(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 40).select("o_orderkey", "rn")


@query(
    "q37_quota_sample",
    "SELECT c_mktsegment, c_custkey, CAST(rn AS INT) AS rn FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer WHERE c_acctbal > 0) WHERE rn <= 5",
)
def quota_sample(t):
    return K.quota_sample(t.customer.where("c_acctbal > 0").select("c_mktsegment", "c_custkey"), "c_mktsegment", [F.col("c_custkey")], 5)


@query(
    "q38_fingerprint_frame",
    """
    WITH f AS (SELECT page_id, length(html) AS size, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))), ',') AS shape FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY size, page_id) AS rn, count(*) OVER (PARTITION BY shape) AS n FROM f)
    SELECT shape, page_id, CAST(rn AS INT) AS rn, n FROM r WHERE rn IN (1, n, n // 2 + 1)
    """,
)
def fingerprint_frame(t):
    shape = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1))), ",")
    f = t.pages.select("page_id", F.length("html").alias("size"), shape.alias("shape"))
    sizes = f.groupBy("shape").agg(F.count("*").alias("n"))
    r = f.withColumn("rn", F.row_number().over(Window.partitionBy("shape").orderBy("size", "page_id"))).join(sizes, "shape")
    return r.where((F.col("rn") == 1) | (F.col("rn") == F.col("n")) | (F.col("rn") == F.floor(F.col("n") / 2) + 1)).select("shape", "page_id", "rn", "n")


@query("q39_tree_path", "SELECT n_name AS leaf, r_name || CASE WHEN n_nationkey % 2 = 0 THEN ' / EVEN' ELSE '' END AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_path(t):
    # region folders, a sub-folder for even nations, leaves out of step with their depth
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    even = (F.col("n_nationkey") % 2).cast("int")
    root = t.region.select("r_regionkey", F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("depth"), F.lit("ALL").alias("name"), F.lit("folder").alias("kind"))
    top = t.region.select("r_regionkey", F.lit(0), F.lit(1), F.lit(1), "r_name", F.lit("folder"))
    sub = t.region.select("r_regionkey", F.lit(2), F.lit(0), F.lit(2), F.lit("EVEN"), F.lit("folder"))
    leaves = n.select("r_regionkey", F.when(even == 1, 1).otherwise(3), F.col("n_nationkey"), F.lit(5), "n_name", F.lit("table"))
    rows = root.union(top).union(sub).union(leaves).withColumn("pos", F.struct("o1", "o2"))
    return tree_paths(rows, "r_regionkey", "pos", "depth", "name", "kind").where("kind = 'table'").select(F.col("name").alias("leaf"), "path")


@query(
    "q40_lead_pairs",
    """
    WITH l AS (SELECT conv_id, turn, role, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2, lead(length(text), 2) OVER w AS n2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, role, r1 AS next_role, CAST(n2 AS INT) AS n2 FROM l WHERE r2 = role
    """,
)
def lead_pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    l = t.conversations.select("conv_id", "turn", "role", F.lead("role", 1).over(w).alias("next_role"), F.lead("role", 2).over(w).alias("r2"), F.lead(F.length("text"), 2).over(w).alias("n2"))
    return l.where("r2 = role").drop("r2")


@query(
    "q79_mode_in_array",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS c, generate_subscripts(string_split(lower(text), ' '), 1) AS p FROM documents),
    g AS (SELECT doc_id, c, count(*) AS n, min(p) AS p FROM l GROUP BY 1, 2) SELECT doc_id, arg_max(c, n * 1000000000 - p) AS top FROM g GROUP BY 1
    """,
)
def mode_in_array(t):
    words = t.documents.select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("p", "c"))
    g = words.groupBy("doc_id", "c").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    return g.groupBy("doc_id").agg(F.max_by("c", F.struct("n", -F.col("p"))).alias("top"))


@query(
    "q80_guarded_ratios",
    """
    WITH s AS (SELECT l_shipdate::DATE AS d, count(*) FILTER (l_returnflag = 'R') AS killed, count(*) FILTER (l_returnflag <> 'N') AS killable, median(l_quantity) AS med, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT d, CASE WHEN killable = 0 THEN 1.0 ELSE round_even(CAST(killed AS DOUBLE) / killable, 3) END AS rate, killable >= 5 AS enough, round_even(med * 100, 4) AS low_estimate, round_even(mean * 100, 4) AS high_estimate, n >= 10 AS complete FROM s
    """,
)
def guarded_ratios(t):
    s = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("killed"), F.count_if(F.col("l_returnflag") != "N").alias("killable"), F.median("l_quantity").alias("med"), F.avg("l_quantity").alias("mean"), F.count("*").alias("n")
    )
    rate = F.bround(Q.guarded_ratio(F.col("killed"), F.col("killable"), 1.0), 3)
    return s.select("d", rate.alias("rate"), (F.col("killable") >= 5).alias("enough"), F.bround(F.col("med") * 100, 4).alias("low_estimate"), F.bround(F.col("mean") * 100, 4).alias("high_estimate"), (F.col("n") >= 10).alias("complete"))


@query(
    "q81_key_census",
    "WITH k AS (SELECT unnest(json_keys(props)) AS path, props FROM events) SELECT path, count(*) AS n, CAST(sum(len(regexp_extract_all(props, '[0-9]+'))) AS BIGINT) AS numbers FROM k GROUP BY 1",
)
def key_census(t):
    k = t.events.select(F.explode(F.json_object_keys("props")).alias("path"), F.regexp_count("props", F.lit("[0-9]+")).alias("numbers"))
    return k.groupBy("path").agg(F.count("*").alias("n"), F.sum("numbers").alias("numbers"))


def _responses(t):
    body = F.concat(
        F.lit('{"a":{"b":[{"valor":"1,5","d":{"e":true}},{"zz":1}],"l6":{"l5":{"l4":{"l3":{"l2":{"geo":{"deep":1}}}}}}},"n":null,"dim_1":"'),
        F.col("event_id").cast("string"),
        F.lit('","props":'),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("[]"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("}"),
    )
    return t.events.select("event_id", body.alias("body"))


RESPONSE_PATHS = """
    fixed(path, kind) AS (VALUES ('a', 'object'), ('a.b', 'array'), ('a.b[].valor', 'string'), ('a.b[].d', 'object'), ('a.b[].d.e', 'boolean'), ('a.l6', 'object'), ('a.l6.l5', 'object'), ('a.l6.l5.l4', 'object'),
      ('a.l6.l5.l4.l3', 'object'), ('a.l6.l5.l4.l3.l2', 'object'), ('a.l6.l5.l4.l3.l2.geo', 'object'), ('n', 'null'), ('dim_1', 'string')),
    good AS (SELECT * FROM events WHERE event_id % 5 <> 0),
    paths AS (SELECT event_id, path, kind FROM good, fixed UNION ALL SELECT event_id, 'props', CASE WHEN event_id % 2 = 0 THEN 'object' ELSE 'array' END FROM good
      UNION ALL SELECT event_id, 'props.' || unnest(json_keys(props)), 'number' FROM good WHERE event_id % 2 = 0)
"""


@query("q116_nested_census", f"WITH {RESPONSE_PATHS} SELECT path, kind, count(*) AS n FROM paths GROUP BY 1, 2")
def nested_census(t):
    """Paths of nested responses down to six levels; every fifth does not parse."""
    return N.key_paths(_responses(t), "event_id", "body").groupBy("path", "kind").agg(F.count("*").alias("n"))


@query(
    "q119_response_profile",
    f"""
    WITH {RESPONSE_PATHS}, g AS (SELECT event_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(path) FILTER (regexp_matches(path, '(?i)valor|value|dim_|geo|dsg|ano|periodo'))))[1:20], ',') AS names FROM paths GROUP BY 1)
    SELECT event_id, 2 + CASE WHEN event_id % 2 = 0 THEN len(regexp_extract_all(props, '"[0-9]+[.,]?[0-9]*"')) ELSE 0 END AS numbers, coalesce(n, 0) AS key_count, coalesce(names, '') AS value_like_keys
    FROM events LEFT JOIN g USING (event_id)
    """,
)
def response_profile(t):
    return N.response_profile(_responses(t), "event_id", "body").withColumn("numbers", F.col("numbers").cast("long"))


@query("q82_last_match", "SELECT user_id, arg_max(event_id, event_id) AS last_event, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def last_match(t):
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("value", "event_id").alias("value"))


@query(
    "q83_distinct_examples",
    """
    WITH d AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_name) AS rn FROM d)
    SELECT p_brand, p_name, CAST(rn AS INT) AS rn FROM r WHERE rn <= 3
    """,
)
def distinct_examples(t):
    d = t.part.select("p_brand", "p_name").distinct()
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.length("p_name"), "p_name"))).where("rn <= 3")


@query(
    "q85_top_n_and_more",
    """
    WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_name) AS rn FROM c)
    SELECT CASE WHEN rn <= 10 THEN p_name ELSE 'and more' END AS name, CAST(sum(n) AS BIGINT) AS n, count(*) AS members FROM r GROUP BY 1
    """,
)
def top_n_and_more(t):
    c = t.part.groupBy("p_name").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "p_name").limit(10).select("p_name", F.lit(True).alias("top"))
    j = c.join(F.broadcast(top), "p_name", "left")
    return j.groupBy(F.when(F.col("top"), F.col("p_name")).otherwise("and more").alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("members"))


@query(
    "q86_first_seen_list",
    "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY 1",
)
def first_seen_list(t):
    f = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda s: s["role"])
    return f.groupBy("conv_id").agg(F.array_join(listed, ",").alias("roles"))


@query(
    "q94_sample_verdicts",
    "SELECT doc_id % 10 AS bucket, CASE WHEN bool_and(quality = 1) THEN 'all' WHEN NOT bool_or(quality = 1) THEN 'none' ELSE 'mixed' END AS verdict FROM labels GROUP BY 1",
)
def sample_verdicts(t):
    good = F.col("quality") == 1
    return t.labels.groupBy((F.col("doc_id") % 10).alias("bucket")).agg(F.when(F.bool_and(good), "all").when(~F.bool_or(good), "none").otherwise("mixed").alias("verdict"))


@query(
    "q98_slices_flat",
    """
    SELECT doc_id, md5(lang || '|' || source || '|' || lang || '|' || text) AS slices,
      '{' || '"lang":"' || lang || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"source":"' || source || '"' ELSE '' END || '}' AS body FROM documents
    """,
)
def slices_flat(t):
    m = F.create_map(F.lit("a"), F.array("lang", "source"), F.lit("b"), F.array("lang", "text"))
    body = F.to_json(F.struct("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source")))
    return t.documents.select("doc_id", F.md5(F.array_join(P.slices_of(m), "|")).alias("slices"), body.alias("body"))


@query(
    "q110_bounded_run",
    """
    WITH r AS (SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS spent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pages FROM orders)
    SELECT o_custkey, o_orderkey, CAST(pages AS INT) AS pages FROM r WHERE spent <= 600000 AND pages <= 5
    """,
)
def bounded_run(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = t.orders.select("o_custkey", "o_orderkey", F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"), F.row_number().over(w).alias("pages"))
    return r.where("spent <= 600000 AND pages <= 5").drop("spent")
