"""Queries of the catalogue build and its flat forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keyed as K
from ..operators import pages as P
from ..sources import writers as W
from .base import query


@query(
    "q58_catalogue_build",
    """
    WITH r AS (SELECT page_id AS id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS area, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS name, url FROM pages),
    d AS (SELECT doc_id AS id, lang AS area, source FROM documents), l AS (SELECT doc_id AS id, quality FROM labels)
    SELECT r.area, r.id, r.name, coalesce(d.source, '') AS source, CASE WHEN l.quality = 1 THEN 'featured' ELSE '' END AS featured, r.id % 5 = 0 AS removed FROM r LEFT JOIN d USING (area, id) LEFT JOIN l USING (id)
    """,
)
def catalogue_build(t):
    h = F.col("html")
    r = t.pages.select(F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("area"), F.col("page_id").alias("id"), P.title_of(h).alias("name"), "url")
    d = t.documents.select(F.col("lang").alias("area"), F.col("doc_id").alias("id"), "source")
    featured = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("featured").alias("featured"))
    live = t.pages.where("page_id % 5 <> 0").select("url", "page_id")
    marked = K.with_tombstones(r, live.select(F.col("page_id").alias("id")), "id")
    j = marked.join(d, ["area", "id"], "left").join(featured, "id", "left")
    return j.select("area", "id", "name", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("featured", F.lit("")).alias("featured"), "removed")


@query(
    "q104_flat_row_strings",
    """
    SELECT p_partkey, p_name || ' | ' || p_type AS names, CASE WHEN p_size > 25 THEN 'yes' ELSE '' END AS large,
      '{"@type":"Dataset","name":"' || p_name || ' \\u003cb\\u003e"' || CASE WHEN p_size > 25 THEN ',"unit":"' || p_type || '"' ELSE '' END || '}' AS body FROM part
    """,
)
def flat_row_strings(t):
    rows = t.part.select(
        "p_partkey",
        F.array("p_name", "p_type").alias("names"),
        (F.col("p_size") > 25).alias("large"),
        W.dataset_descriptor({"@type": F.lit("Dataset"), "name": F.concat("p_name", F.lit(" <b>")), "unit": F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")}).alias("body"),
    )
    return W.flat(rows)


@query("q104_page_documents", "SELECT p_partkey, '<!doctype html><title>' || p_name || '</title><meta name=\"version\" content=\"' || left(sha256(p_brand), 8) || '\"><main>' || p_brand || ' &amp; co</main>' AS page FROM part")
def page_documents(t):
    from ..functions.hashing import version

    return t.part.select("p_partkey", W.page_document(F.col("p_name"), F.concat("p_brand", F.lit(" & co")), version(F.col("p_brand"))).alias("page"))


@query("q04_exact_fold")
def exact_fold(t):
    """The full Unicode fold beside the JVM one."""
    return t.documents.select("doc_id", (P.fold_exact(F.col("text")) == T.fold(F.col("text"))).alias("same"))
