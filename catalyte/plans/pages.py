"""Queries over pages and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..sources import readers as R
from .base import query

#: What the pages hold; &amp; last, as it may begin another.
UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g')"


@query(
    "q53_page_fields",
    f"""
    SELECT page_id, trim({UNESCAPE.format(x="regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")}) AS title,
      trim({UNESCAPE.format(x="regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")}) AS h1, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
      md5(regexp_replace({UNESCAPE.format(x=f"regexp_replace({BARE}, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS body,
      'CO₂ ' || regexp_extract(html, '<html lang="([a-z]+)"', 1) || ' km²³ < ' || page_id AS clean FROM pages
    """,
)
def page_fields(t):
    h = F.col("html")
    lang = F.regexp_extract(h, '<html lang="([a-z]+)"', 1)
    marked = F.concat(F.lit("CO<sub>2</sub> <em>"), lang, F.lit("</em>  km<sup>23</sup> < "), F.col("page_id").cast("string"))
    return t.pages.select(
        "page_id",
        P.title_of(h).alias("title"),
        F.trim(T.unescape(F.regexp_extract(h, r"(?s)<h1[^>]*>(.*?)</h1>", 1))).alias("h1"),
        lang.alias("lang"),
        F.md5(T.page_text(h)).alias("body"),
        T.strip_tags(T.unicode_digits(marked)).alias("clean"),
    )


@query(
    "q54_page_lines",
    f"""
    WITH l AS (SELECT page_id, list_filter(list_transform(string_split({UNESCAPE.format(x=f"regexp_replace({BARE}, '<[^>]+>', chr(10), 'g')")}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)
    SELECT page_id, CAST(len(l) AS BIGINT) AS n, l[1] AS first_line, list_filter(l, lambda x: length(x) > 100)[1] AS first_long FROM l
    """,
)
def page_lines(t):
    l = t.pages.select("page_id", P.lines_of(F.col("html")).alias("l"))
    long = F.try_element_at(F.filter("l", lambda x: F.length(x) > 100), F.lit(1))
    return l.select("page_id", F.size("l").cast("long").alias("n"), F.try_element_at("l", F.lit(1)).alias("first_line"), long.alias("first_long"))


@query("q55_marker_windows")
def marker_windows(t):
    text = F.concat(F.lit("12 345 Fontes/Entidades: X 1,5 "), F.col("text"))
    w = t.documents.select("doc_id", P.marker_windows(text, ["Fontes", "tion", "de"]).alias("w"))
    return w.select("doc_id", F.explode("w").alias("marker", "spans")).select("doc_id", "marker", F.posexplode("spans").alias("pos", "excerpt"))


@query(
    "q56_json_fields",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"unparsed":"' || event_type || '"}' AS fallback, 'a' AS period, CAST(event_id % 3 AS BIGINT) AS value FROM events
    UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT), '{"unparsed":"' || event_type || '"}', 'b', CAST(user_id AS BIGINT) FROM events
    """,
)
def json_fields(t):
    nested = F.concat(F.lit('{"d":{"a":[{"v":'), (F.col("event_id") % 3).cast("string"), F.lit('}],"b":[{"v":'), F.col("user_id").cast("string"), F.lit("}]}}"))
    periods = F.variant_get(F.parse_json(nested), "$.d", "map<string,array<struct<v:bigint>>>")
    raw = F.concat(F.lit('<script type="application/ld+json">'), "event_type", F.lit("</script>"))
    x = t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.to_json(P.json_ld_of(raw)).alias("fallback"), F.explode(periods).alias("period", "v"))
    return x.select("event_id", "k", "fallback", "period", F.explode("v.v").alias("value"))


@query("q57_page_inventory")
def page_inventory(t):
    return P.page_inventory(t.pages, "page_id", "html").groupBy("holder").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.min("text").alias("example"))


@query("q57_page_years")
def page_years(t):
    years = F.concat("html", F.lit("<p>1999 <b>from 2001</b></p><i>2004</i>"))
    return P.page_years(t.pages.select("page_id", years.alias("html")), "page_id", "html")


@query("q57_featured_lines")
def featured_lines(t):
    l = t.pages.select("page_id", P.lines_of(F.col("html")).alias("l"))
    return P.featured_lines(l, "page_id", "l")


@query(
    "q114_entities",
    "SELECT doc_id, source || 'ção é €–' || lang || ' &lt; &nosuch; &amp ' || chr(1) || '�' || CAST(length(text) AS VARCHAR) AS plain FROM documents",
)
def entities(t):
    """Named, decimal and hexadecimal references; one that is escaped itself; what
    is none."""
    coded = F.concat("source", F.lit("&ccedil;&atilde;o&nbsp;&#233; &#x20aC;&#150;"), "lang", F.lit(" &amp;lt; &nosuch; &amp &#1;&#xD800;"), F.length("text").cast("string"))
    return t.documents.select("doc_id", T.unescape(coded).alias("plain"))


@query(
    "q115_marker_census",
    "SELECT page_id, (length(html) - length(replace(html, '<p', ''))) // 2 AS paragraphs, (length(html) - length(replace(html, 'href=\"', ''))) // 6 AS links, (length(html) - length(replace(html, '.', ''))) AS stops FROM pages",
)
def marker_census(t):
    counts = P.marker_counts(F.col("html"), {"paragraphs": "<p", "links": 'href="', "stops": "."})
    return t.pages.select("page_id", *(c.cast("long").alias(n) for c, n in zip(counts, ("paragraphs", "links", "stops"), strict=True)))


@query("q101_payload_gzip")
def payload_gzip(t):
    return t.documents.select("doc_id", P.gzip_kb(F.col("text")).alias("kb"), (P.gzip_kb(F.col("text")) <= 250).alias("within"))


@query("q108_xml_records", "SELECT page_id, 'https://h/a-' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN '2024-01-02' ELSE '' END AS lastmod FROM pages")
def xml_records(t):
    k = F.col("page_id").cast("string")
    full = F.concat(F.lit("<urlset><url>\n<loc> https://h/a-"), k, F.lit(" </loc><lastmod>2024-01-02T03:04</lastmod></url></urlset>"))
    bare = F.concat(F.lit("<x><loc>https://h/a-"), k, F.lit("</loc></x>"))
    found = R.sitemap(t.pages.select(F.when(F.col("page_id") % 2 == 0, full).otherwise(bare).alias("value")))
    return found.select(F.regexp_extract("url", r"-(\d+)$", 1).cast("long").alias("page_id"), "url", "lastmod")


@query("q108_xml_series", "SELECT p_partkey AS id, p_name || ' <x>' AS title FROM part")
def xml_series(t):
    doc = F.concat(F.lit('<indicator id="'), F.col("p_partkey").cast("string"), F.lit('"><title><![CDATA[ '), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" <x>\n]]></title></indicator>"))
    x = t.part.select(F.from_xml(doc, "_id long, title string").alias("x"))
    return x.select(F.col("x._id").alias("id"), T.collapse(F.col("x.title")).alias("title"))
