"""Queries of the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from .base import query


def _metrics(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    wide = j.groupBy("lang").agg(
        F.bround(Q.coverage(F.col("quality").isNotNull()), 4).alias("label_ratio"),
        F.bround(Q.coverage(F.length("text") > 200), 4).alias("long_ratio"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit("@"))), F.lit(0)).cast("double").alias("marks"),
    )
    return wide.unpivot("lang", ["label_ratio", "long_ratio", "marks"], "metric", "value").withColumnRenamed("lang", "area").select("metric", "area", "value")


METRICS = """
    j AS (SELECT d.*, quality FROM documents d LEFT JOIN labels USING (doc_id)),
    m AS (SELECT 'label_ratio' AS metric, lang AS area, round_even(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS value FROM j GROUP BY lang
      UNION ALL SELECT 'long_ratio', lang, round_even(avg(CASE WHEN length(text) > 200 THEN 1.0 ELSE 0.0 END), 4) FROM j GROUP BY lang
      UNION ALL SELECT 'marks', lang, CAST(sum(length(text) - length(replace(text, '@', ''))) AS DOUBLE) FROM j GROUP BY lang)
"""
LIMITS = [("label_ratio", "min", 0.3, "en"), ("label_ratio", "min", 0.9, "fr"), ("long_ratio", "max", 0.1, "de"), ("long_ratio", "min", 0.1, "xx"), ("absent", "min", 1.0, "en"), ("marks", "max", 0.0, "es")]
LIMITS_SQL = "l(metric, op, lim, area) AS (VALUES " + ", ".join(f"('{m}', '{o}', {v}::DOUBLE, '{a}')" for m, o, v, a in LIMITS) + ")"


def _limits(t):
    return t.spark.createDataFrame(LIMITS, "metric string, op string, limit double, area string")


@query("q65_quality_metrics", f"WITH {METRICS} SELECT metric, area, value FROM m")
def quality_metrics(t):
    return _metrics(t)


@query(
    "q66_gate_breaches",
    f"""
    WITH {METRICS}, {LIMITS_SQL}
    SELECT l.metric, l.area, l.op, l.lim AS "limit", m.value FROM l LEFT JOIN m ON l.metric = m.metric AND l.area = m.area
    WHERE l.metric IN (SELECT metric FROM m) AND (m.value IS NULL OR (l.op = 'min' AND m.value < l.lim) OR (l.op = 'max' AND m.value > l.lim))
    """,
)
def gate_breaches(t):
    return Q.breaches(_metrics(t), _limits(t))


DEFECTS = {"separator": r"\S \? \S", "value": r"\d+,\d+", "entity": "&[a-z]+;"}


@query(
    "q67_residual_defects",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{k}' AS pattern, CAST(coalesce(sum(len(regexp_extract_all({f}, '{p}'))), 0) AS BIGINT) AS n FROM documents" for f in ("text", "lang", "source") for k, p in DEFECTS.items()
    ),
)
def residual_defects(t):
    return Q.residual_defects(t.documents, DEFECTS)


@query(
    "q69_unit_vocabulary",
    """
    WITH v(term, label) AS (VALUES ('ECONOMY', 'Economia'), ('SMALL', 'Pequeno'), ('Brand#1', 'Marca 1'))
    SELECT p_partkey, coalesce(a.label, p_brand) || ' - ' || coalesce(b.label, p_type) AS unit, concat_ws('|', CASE WHEN a.label IS NULL THEN p_brand END, CASE WHEN b.label IS NULL THEN p_type END) AS untranslated
    FROM part LEFT JOIN v a ON p_brand = a.term LEFT JOIN v b ON p_type = b.term
    """,
)
def unit_vocabulary(t):
    labels = F.create_map(*(F.lit(x) for pair in (("ECONOMY", "Economia"), ("SMALL", "Pequeno"), ("Brand#1", "Marca 1")) for x in pair))
    parts = F.split(F.concat_ws(" - ", "p_brand", "p_type"), " - ")
    told = F.transform(parts, lambda p: F.coalesce(F.try_element_at(labels, p), p))
    return t.part.select("p_partkey", F.array_join(told, " - ").alias("unit"), F.array_join(F.filter(parts, lambda p: F.try_element_at(labels, p).isNull()), "|").alias("untranslated"))


@query(
    "q87_threshold_audit",
    f"WITH {METRICS}, {LIMITS_SQL} SELECT 'unmeasured' AS kind, metric, CAST(NULL AS VARCHAR) AS area FROM (SELECT DISTINCT metric FROM l WHERE metric NOT IN (SELECT metric FROM m)) UNION ALL "
    "SELECT 'unreachable', l.metric, l.area FROM l JOIN m ON l.metric = m.metric AND l.area = m.area WHERE op = 'min' AND lim > 0.8 AND m.value < lim",
)
def threshold_audit(t):
    m, l = _metrics(t), _limits(t)
    ceilings = m.where("metric = 'label_ratio'").select("metric", "area", F.lit(0.8).alias("ceiling"))
    a = Q.unmeasured(m, l).select(F.lit("unmeasured").alias("kind"), "metric", F.lit(None).cast("string").alias("area"))
    return a.union(Q.unreachable_floors(m, l, ceilings).select(F.lit("unreachable"), "metric", "area"))


@query(
    "q99_floor_report",
    """
    SELECT 'corpus' AS rule, (SELECT count(*) FROM documents) >= 0.95 * (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS ok
    UNION ALL SELECT 'pages', (SELECT count(*) FROM pages) >= 100 UNION ALL SELECT 'volume', (SELECT count(*) FROM labels) >= 50
    UNION ALL SELECT 'same_lists', (SELECT count(DISTINCT lower(p_name)) FROM part) = (SELECT count(DISTINCT p_name) FROM part) UNION ALL SELECT 'contaminated', (SELECT count(*) FROM documents WHERE regexp_matches(source, 'Carregue|ver tabela')) = 0
    """,
)
def floor_report(t):
    n = lambda df: df.agg(F.count("*").alias("n"))
    rules = [
        n(t.documents).join(F.broadcast(n(t.documents.where("doc_id % 2 = 0")).withColumnRenamed("n", "o")), F.lit(True)).select(F.lit("corpus").alias("rule"), (F.col("n") >= 0.95 * F.col("o")).alias("ok")),
        n(t.pages).select(F.lit("pages"), F.col("n") >= 100),
        n(t.labels).select(F.lit("volume"), F.col("n") >= 50),
        # the names with footnote marks and in capitals make the list that they make without
        t.part.agg(F.count_distinct(T.strip_footnotes(F.concat(F.upper("p_name"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")))).alias("n"), F.count_distinct("p_name").alias("o")).select(F.lit("same_lists"), F.col("n") == F.col("o")),
        t.documents.agg(F.count_if(F.col("source").rlike("Carregue|ver tabela")).alias("n")).select(F.lit("contaminated"), F.col("n") == 0),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out


@query(
    "q100_findings_unpivot",
    """
    WITH r AS (SELECT doc_id, unnest(['short', 'no_label', 'mail']) AS label, unnest([length(text) < 200, quality IS NULL, contains(text, '@')]) AS bad FROM documents LEFT JOIN labels USING (doc_id))
    SELECT label, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:8], ',') AS first FROM r WHERE bad GROUP BY 1
    """,
)
def findings_unpivot(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    return Q.findings(j, "doc_id", {"short": F.length("text") < 200, "no_label": F.col("quality").isNull(), "mail": F.contains("text", F.lit("@"))})


@query(
    "q99_leaked_values",
    "SELECT CAST(sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaks FROM part",
)
def leaked_values(t):
    """Excerpts with a decimal, with a negative and a grouped one, with a grouped
    one, and with what only looks like values: years, dates, parts of numbers."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    excerpts = F.array_compact(
        F.array(
            F.concat(F.lit("em 2023, 2023-01-02, 1,2,3 e 10.5 "), key),
            F.when(size % 2 == 0, F.concat(F.lit("valor "), key, F.lit(",5 de"))),
            F.when(size % 3 == 0, F.concat(F.lit("-"), key, F.lit(",25 e 12 345 678"))),
            F.when(size % 5 == 0, F.lit("1.234 pessoas")),
        )
    )
    return Q.leaked_values(t.part, excerpts)
