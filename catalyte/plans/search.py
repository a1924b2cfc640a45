"""Queries of the catalogue search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as S
from .base import query

TERMS = ("widgt", "brand")
QUERY = "widgt brand"


def _prepared(t):
    rows = t.part.select(
        F.col("p_partkey").alias("id"),
        F.lower("p_type").alias("area"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("name_en"),
        F.concat_ws(" ", F.lit("Índice"), "p_type").alias("description"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("20"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit("-01-01"))).alias("updated"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("array<string>")).otherwise(F.slice(F.array(F.lit("alfa - x"), F.lit("beta"), F.lit("gama")), F.lit(1), F.col("p_size") % 3 + 1)).alias("sources"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("featured"),
    )
    return S.prepare(rows, "name", ["name_en", "description"], ["sources"])


BASE = """
    b AS (SELECT p_partkey AS id, lower(p_type) AS area, p_name AS name, p_brand AS name_en, 'Índice ' || p_type AS description,
      CASE WHEN p_size % 5 = 0 THEN '' ELSE '20' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') || '-01-01' END AS updated,
      CASE WHEN p_size % 7 = 0 THEN NULL ELSE (['alfa - x', 'beta', 'gama'])[1:(p_size % 3 + 1)] END AS sources, p_size % 2 = 0 AS featured FROM part),
    h AS (SELECT *, strip_accents(lower(name)) AS n, strip_accents(lower(name || ' ' || name_en || ' ' || description || coalesce(' ' || array_to_string(sources, ' '), ''))) AS hay FROM b),
    w AS (SELECT *, list_filter(string_split_regex(hay, '[^a-z0-9%€]+'), lambda x: length(x) > 1) AS words FROM h),
    s AS (SELECT *, CASE WHEN contains(n, 'widgt') THEN 3 WHEN contains(hay, 'widgt') THEN 2 WHEN len(list_filter(words, lambda x: levenshtein(x, 'widgt') <= 1)) > 0 THEN 1 ELSE 0 END AS s1,
      CASE WHEN contains(n, 'brand') THEN 3 WHEN contains(hay, 'brand') THEN 2 WHEN len(list_filter(words, lambda x: levenshtein(x, 'brand') <= 1)) > 0 THEN 1 ELSE 0 END AS s2 FROM w)
"""


@query("q45_search_gate_score", f"WITH {BASE} SELECT id, CAST(1 + s1 + s2 AS INT) AS score FROM s WHERE s1 > 0 AND s2 > 0 AND area IN ('economy', 'small')")
def search_gate_score(t):
    return S.scored(_prepared(t), QUERY, ["economy", "small"]).select("id", "score")


def _ranked(t, mode: str):
    """The order as a rank inside an area: sorted per area, not in one task."""
    p = _prepared(t)
    keys = S.order_columns(mode, F.col("name"), F.col("updated"), F.size("sources"))
    return p.select("area", "id", F.row_number().over(Window.partitionBy("area").orderBy(*keys, "id")).alias("place"))


def _order_sql(order: str) -> str:
    return f"WITH {BASE} SELECT area, id, CAST(row_number() OVER (PARTITION BY area ORDER BY {order}, id) AS INT) AS place FROM b"


for _name, _mode, _order in (
    ("q46_search_az", "az", "name"),
    ("q47_search_za", "za", "name DESC"),
    ("q48_search_new", "new", "nullif(updated, '') DESC NULLS LAST, name"),
    ("q49_search_old", "old", "nullif(updated, '') ASC NULLS LAST, name"),
    ("q50_search_src", "srcMany", "coalesce(len(sources), 0) DESC, nullif(updated, '') DESC NULLS LAST, name"),
    ("q50_search_src_few", "srcFew", "coalesce(len(sources), 0), nullif(updated, '') DESC NULLS LAST, name"),
):
    query(_name, _order_sql(_order))(lambda t, mode=_mode: _ranked(t, mode))


@query(
    "q52_search_page",
    f"""
    WITH {BASE}, o AS (SELECT *, row_number() OVER (ORDER BY name_en, area, id) AS rn FROM b)
    SELECT id, name_en AS shown, name AS alt, CASE WHEN len(sources) > 1 THEN 'alfa +' || (len(sources) - 1) ELSE coalesce(CASE WHEN len(sources) = 1 THEN 'alfa' END, '') END AS credit FROM o WHERE rn > 10 AND rn <= 40
    """,
)
def search_page(t):
    from ..functions.text import short_sources

    shown, alt = S.display_name(F.col("name"), F.col("name_en"), "en")
    page = S.search(_prepared(t), "", mode="az", lang="en", offset=10, limit=30, collation="UTF8_BINARY")
    return page.select("id", shown.alias("shown"), alt.alias("alt"), short_sources(F.col("sources")).alias("credit"))


@query(
    "q106_search_full",
    f"""
    WITH {BASE}, o AS (SELECT *, row_number() OVER (ORDER BY nullif(updated, '') DESC NULLS LAST, name, area, id) AS rn FROM s WHERE s1 > 0 AND s2 > 0 AND featured)
    SELECT id, CAST(1 + s1 + s2 AS INT) AS score FROM o WHERE rn <= 25
    """,
)
def search_full(t):
    return S.search(_prepared(t), QUERY, mode="new", summary_only=True, limit=25).select("id", "score")
