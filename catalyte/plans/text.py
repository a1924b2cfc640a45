"""Queries of the text, date and hash scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import hashing as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import pages as P
from .base import query

TODAY = "2001-06-30"
STOP_PT = ", ".join(f"'{w}'" for w in T.STOPWORDS_PT)
DERIVED = ", ".join(f"'{w}'" for w in T.DERIVATION)
#: DuckDB: distinct content words of {x}, sorted.
WORDS = (
    "list_sort(list_distinct(list_filter(string_split_regex(strip_accents(lower({x})), '[^a-z0-9]+'), "
    "lambda w: (length(w) > 2 OR regexp_full_match(w, '[0-9]+')) AND NOT list_contains([" + STOP_PT + "], w))))"
)


@query(
    "q01_url_classify",
    """
    WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '-' || page_id AS u FROM pages),
    p AS (SELECT page_id, u, lower(regexp_extract(u, '^[a-z]+://([^/]+)', 1)) AS host, regexp_extract(u, '^[a-z]+://[^/]+/([^/]*)', 1) AS section FROM u),
    a AS (SELECT *, (starts_with(u, 'https://') AND (host = 'example.com' OR suffix(host, '.example.com')) AND section IN ('en', 'de', 'fr')
      AND NOT contains(u, '/es/') AND NOT contains(u, 'quadro+resumo')) AS accepted FROM p)
    SELECT page_id, accepted, CASE WHEN accepted THEN section END AS section, CASE WHEN accepted THEN page_id END AS id,
      regexp_replace(u, '^[a-z]+://[^/]+/?', '') AS short FROM a
    """,
)
def url_classify(t):
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("-"), F.col("page_id").cast("string"))
    accepted = U.is_listed_page(F.col("u"), "example.com", ["en", "de", "fr"], not_under=("/es/",))
    section, number = U.section_and_id(F.col("u"), F.col("accepted"))
    return t.pages.select("page_id", url.alias("u")).withColumn("accepted", accepted).select("page_id", "accepted", section.alias("section"), number.alias("id"), U.short_url(F.col("u")).alias("short"))


@query("q02_accent_fold", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def accent_fold(t):
    return t.documents.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(
    "q03_norm_title",
    """
    SELECT 'p' || p_partkey AS k, trim(regexp_replace(strip_accents(lower(p_name || ' (N.º)')), '[^a-z0-9]+', ' ', 'g')) AS norm,
      trim(regexp_replace(regexp_replace(strip_accents(lower(p_name || ' (N.º)')), '\\s*\\([^)]{1,12}\\)\\s*$', ''), '[^a-z0-9]+', ' ', 'g')) AS bare FROM part
    UNION ALL
    SELECT 'd' || doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))),
      md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '\\s*\\([^)]{1,12}\\)\\s*$', ''), '[^a-z0-9]+', ' ', 'g'))) FROM documents
    """,
)
def norm_title(t):
    title = F.concat("p_name", F.lit(" (N.º)"))
    parts = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"), T.norm_title(title).alias("norm"), T.bare_title(title).alias("bare"))
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.md5(T.norm_title(F.col("text"))), F.md5(T.bare_title(F.col("text"))))
    return parts.union(docs)


@query(
    "q04_content_tokens",
    f"""
    WITH w AS (SELECT doc_id, {WORDS.format(x="text")} AS w,
      list_filter(string_split_regex(strip_accents(lower(text)), '[^a-z0-9]+'), lambda w: (length(w) > 2 OR regexp_full_match(w, '[0-9]+')) AND NOT list_contains([{STOP_PT}], w)) AS o FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, o[1] AS head, md5(array_to_string(w, ' ')) AS tokens FROM w
    """,
)
def content_tokens(t):
    w = t.documents.select("doc_id", T.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.try_element_at("w", F.lit(1)).alias("head"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("tokens"))


STOP_NAMES = ", ".join(f"'{w}'" for w in T.STOPWORDS_NAMES)


@query(
    "q05_plural_tokens",
    f"""
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(
      list_filter(string_split(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(p_name || 's e Índices-chave')), '-', ''), '[^a-z0-9_\\s%€]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
        lambda w: length(w) >= 2 AND NOT list_contains([{STOP_NAMES}], w)),
      lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END))), ' ') AS tokens FROM part
    """,
)
def plural_tokens(t):
    return t.part.select("p_partkey", F.array_join(T.name_tokens(F.concat("p_name", F.lit("s e Índices-chave"))), " ").alias("tokens"))


@query(
    "q06_strip_unit",
    """
    SELECT p_partkey, trim(regexp_replace(p_name || CASE WHEN p_size % 2 = 0 THEN ' (euro) (2010-2020)' ELSE ' (BMI)' END,
      '(?i)(?:\\s*\\((?:euro|percentage|pps|euro ecu|eu27 100|at current prices|[0-9]{4}[^)]*|nace[^)]*|isced[^)]*)\\))+\\s*$', '')) AS bare FROM part
    """,
)
def strip_unit(t):
    return t.part.select("p_partkey", T.strip_unit(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (euro) (2010-2020)").otherwise(" (BMI)"))).alias("bare"))


@query(
    "q07_split_tail",
    """
    WITH x AS (SELECT p_partkey, p_name || ', by ' || p_brand || ' and by size' AS s, p_name || ' — ' || p_type || ' – x' AS d FROM part)
    SELECT p_partkey, trim(regexp_replace(s, '(?is)\\s*,?\\s*\\bby\\b.*$', '')) AS head,
      trim(substr(s, length(regexp_replace(s, '(?is)\\s*,?\\s*\\bby\\b.*$', '')) + 1)) AS tail, trim(string_split_regex(d, '\\s+[—–-]\\s+')[1]) AS concept FROM x
    """,
)
def split_tail(t):
    head, tail = T.split_tail(F.concat("p_name", F.lit(", by "), "p_brand", F.lit(" and by size")))
    return t.part.select("p_partkey", head.alias("head"), tail.alias("tail"), T.before_dash(F.concat("p_name", F.lit(" — "), "p_type", F.lit(" – x"))).alias("concept"))


@query(
    "q08_breakdown_split",
    """
    WITH x AS (SELECT p_partkey, p_name || CASE p_size % 5 WHEN 0 THEN ': por ' || lower(p_type) WHEN 1 THEN ': total e por ' || lower(p_type) WHEN 2 THEN ': por mil habitantes'
      WHEN 3 THEN ': a: b' ELSE ': homens e mulheres' END AS s FROM part),
    y AS (SELECT *, trim(split_part(s, ':', 1)) AS h, trim(substr(s, strpos(s, ':') + 1)) AS b, length(s) - length(replace(s, ':', '')) AS n FROM x),
    z AS (SELECT *, n = 1 AND h <> '' AND (regexp_matches(b, '(?i)^(total\\s+e\\s+por\\b|total,\\s|total\\s+e\\s+|homens\\s+e\\s+mulheres\\b|\\w+\\s+e\\s+\\w+\\s+por\\b)')
      OR (regexp_matches(b, '(?i)^por\\s+\\w') AND NOT regexp_matches(b, '(?i)^por\\s+(cem|mil|100|habitante)'))) AS ok FROM y)
    SELECT p_partkey, CASE WHEN ok THEN h ELSE s END AS title, CASE WHEN ok THEN b ELSE '' END AS breakdown FROM z
    """,
)
def breakdown_split(t):
    low = F.lower("p_type")
    tail = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(": por "), low)).when(F.col("p_size") % 5 == 1, F.concat(F.lit(": total e por "), low)).when(F.col("p_size") % 5 == 2, ": por mil habitantes").when(F.col("p_size") % 5 == 3, ": a: b").otherwise(": homens e mulheres")
    title, breakdown = T.split_breakdown(F.col("s"))
    return t.part.select("p_partkey", F.concat("p_name", tail).alias("s")).select("p_partkey", title.alias("title"), breakdown.alias("breakdown"))


@query(
    "q09_source_orgs",
    """
    SELECT doc_id, upper(source) || CASE WHEN upper(lang) <> upper(source) THEN '|' || upper(lang) ELSE '' END AS orgs,
      upper(source) || ' (a partir de 2001) - total|' || upper(lang) || '/MIN|CURATOR' AS sources, upper(source) || ' (a partir de 2001) +2' AS short FROM documents
    """,
)
def source_orgs(t):
    raw = F.concat(F.upper("source"), F.lit(" (a partir de 2001) - total, "), F.upper("lang"), F.lit("/MIN; CURATOR ; CURATOR - Carregue aqui"))
    s = t.documents.select("doc_id", T.split_sources(raw).alias("s"))
    return s.select("doc_id", F.array_join(T.source_orgs(F.col("s"), "CURATOR"), "|").alias("orgs"), F.array_join("s", "|").alias("sources"), T.short_sources(F.col("s")).alias("short"))


@query(
    "q10_separator_repair",
    """
    SELECT p_partkey, regexp_replace(regexp_replace(s, '(\\S) \\? (\\S)', '\\1 – \\2', 'g'), '(\\S) \\? (\\S)', '\\1 – \\2', 'g') AS fixed
    FROM (SELECT p_partkey, p_name || ' ? A ? ' || p_brand || ' ?' AS s FROM part)
    """,
)
def separator_repair(t):
    return t.part.select("p_partkey", T.fix_separator(F.concat("p_name", F.lit(" ? A ? "), "p_brand", F.lit(" ?"))).alias("fixed"))


@query(
    "q11_acronym_restore",
    """
    SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' isced 5 eu27 brand isceds', '\\bisced\\b', 'ISCED', 'g'), '\\beu27\\b', 'EU27', 'g') AS name FROM part
    """,
)
def acronym_restore(t):
    return t.part.select("p_partkey", T.restore_acronyms(F.concat("p_name", F.lit(" isced 5 eu27 brand isceds")), F.concat("p_name", F.lit(" (ISCED 5) EU27, A "), "p_brand")).alias("name"))


@query("q12_slug_names", "SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) || ' a b' AS name, lower(replace(p_name, ' ', '-')) || '-' || lower(p_type) AS slug FROM part")
def slug_names(t):
    path = F.concat(F.lit("https://h/x/"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("+a%2Bb-"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", T.name_from_slug(path).alias("name"), U.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query(
    "q13_date_shape_recency",
    f"""
    WITH x AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '2026-02-31' WHEN 1 THEN '' WHEN 2 THEN '1989-12-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
    SELECT o_orderkey, regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND coalesce(TRY_CAST(d AS DATE) BETWEEN DATE '1990-01-01' AND DATE '{TODAY}' + 2, false) AS valid,
      CASE WHEN d = '' THEN '' WHEN 2001 - CAST(left(d, 4) AS INT) <= 1 THEN 'current' WHEN 2001 - CAST(left(d, 4) AS INT) <= 5 THEN 'recent' ELSE 'stale' END AS recency,
      CASE WHEN d = '' THEN left(d, 4) ELSE left(d, 4) || '-2001' END AS label FROM x
    """,
)
def date_shape(t):
    day = F.when(F.col("o_orderkey") % 7 == 0, "2026-02-31").when(F.col("o_orderkey") % 7 == 1, "").when(F.col("o_orderkey") % 7 == 2, "1989-12-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    x = t.orders.select("o_orderkey", day.alias("d"))
    last = F.when(F.col("d") != "", "2001")
    return x.select("o_orderkey", D.valid_date(F.col("d"), TODAY).alias("valid"), D.recency(F.col("d"), TODAY).alias("recency"), D.period_label(F.substring("d", 1, 4), last).alias("label"))


@query(
    "q14_markers",
    f"""
    WITH x AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Taxa média (%)' WHEN 1 THEN ' Casos por mil habitantes, sem apoio (N.º)' WHEN 2 THEN ' Índice não ajustado (Série 2021 - ‰)' ELSE '' END AS s FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_concat(list_filter({WORDS.format(x="s")}, lambda w: list_contains([{DERIVED}], w)),
        CASE WHEN regexp_matches(strip_accents(lower(s)), '\\bpor\\s+(mil|cem|100|1000|habitante)') THEN ['per'] ELSE [] END)), ',') AS derivation,
      CASE WHEN contains(regexp_extract(s, '\\(([^)]*)\\)\\s*$', 1), '%') THEN 'pct' WHEN contains(regexp_extract(s, '\\(([^)]*)\\)\\s*$', 1), '‰') THEN 'permil' ELSE '' END AS units,
      array_to_string(list_sort(list_distinct(regexp_extract_all(strip_accents(lower(s)), '\\b(nao|sem|exceto|excepto|excluindo|fora)\\b', 1))), ',') AS negations,
      round(CAST(length(regexp_replace(s, '[^0-9]', '', 'g')) AS DOUBLE) / length(s), 6) AS digits FROM x
    """,
)
def markers(t):
    tail = F.when(F.col("doc_id") % 4 == 0, " Taxa média (%)").when(F.col("doc_id") % 4 == 1, " Casos por mil habitantes, sem apoio (N.º)").when(F.col("doc_id") % 4 == 2, " Índice não ajustado (Série 2021 - ‰)").otherwise("")
    s = F.col("s")
    return t.documents.select("doc_id", F.concat("text", tail).alias("s")).select(
        "doc_id",
        F.array_join(T.derivation_markers(s), ",").alias("derivation"),
        F.array_join(T.unit_markers(T.trailing_unit(s)), ",").alias("units"),
        F.array_join(T.negations(s), ",").alias("negations"),
        F.round(T.digit_ratio(s), 6).alias("digits"),
    )


@query(
    "q51_search_random",
    """
    WITH k AS (SELECT p_partkey, p_name, list_reduce(list_transform(string_split('part/' || p_partkey, ''), lambda c: CAST(ascii(c) AS HUGEINT)),
      lambda h, x: (xor(h, x) * 16777619::HUGEINT) & 4294967295::HUGEINT, (xor(7, 2166136261) & 4294967295)::HUGEINT) AS h FROM part)
    SELECT p_partkey, CAST(h AS BIGINT) AS key, row_number() OVER (PARTITION BY p_name ORDER BY h, p_partkey) AS place FROM k
    """,
)
def search_random(t):
    from pyspark.sql import Window

    k = t.part.select("p_partkey", "p_name", H.fnv1a(7, F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("key"))
    return k.select("p_partkey", "key", F.row_number().over(Window.partitionBy("p_name").orderBy("key", "p_partkey")).cast("long").alias("place"))


@query(
    "q70_scope_filters",
    """
    WITH x AS (SELECT doc_id, lang, upper(source) AS org FROM documents)
    SELECT doc_id, lang IN ('fr', 'de') AND starts_with(org, 'SRC1') AS in_a, lang = 'en' AND starts_with(org, 'SRC2') AS in_b,
      lang <> 'fr' OR org IN ('SRC1', 'SRC3', 'SRC5') AS geo_ok FROM x
    """,
)
def scope_filters(t):
    from ..operators import linkage as L

    sources = F.array(F.concat("source", F.lit(" - total")), F.lit("other"))
    named = lambda p: F.exists(sources, lambda s: F.upper(F.trim(F.split(s, " - ", 2)[0])).startswith(p))
    return t.documents.select("doc_id", (F.col("lang").isin("fr", "de") & named("SRC1")).alias("in_a"), ((F.col("lang") == "en") & named("SRC2")).alias("in_b"), L.geography_ok(F.col("lang"), F.upper("source"), "fr", ["SRC1", "SRC3", "SRC5"]).alias("geo_ok"))


@query(
    "q71_coalesced_phrase",
    """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_name ELSE '' END AS phrase,
      CASE WHEN p_size % 3 = 0 AND p_type <> p_name THEN p_type END AS title FROM part
    """,
)
def coalesced_phrase(t):
    title = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, "")
    name = F.when(F.col("p_size") % 3 == 2, "").otherwise(F.col("p_name"))
    informative = F.when(T.present(title) & (title != F.col("p_name")), title)
    return t.part.select("p_partkey", T.phrase_of(title, name).alias("phrase"), informative.alias("title"))


@query(
    "q72_shape_validators",
    """
    WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ', ' || lang WHEN 1 THEN text WHEN 2 THEN '' ELSE source || ' a b c d e f g h i j k l m n' END AS f,
      CASE doc_id % 4 WHEN 0 THEN 'Km²' WHEN 1 THEN 'a|b' WHEN 2 THEN '12 345' ELSE 'Taxa - %' END AS u, CASE WHEN doc_id % 3 = 0 THEN '2026-02-31' ELSE '2000-01-01' END AS d FROM documents),
    y AS (SELECT *, f <> '' AND length(f) <= 200 AND len(list_filter(list_transform(string_split_regex(f, '[|,;]'), lambda p: trim(p)),
      lambda p: length(p) > 90 OR len(list_filter(string_split_regex(p, '\\s+'), lambda w: w <> '')) > 14)) = 0 AS good_f FROM x)
    SELECT doc_id, good_f AS sources_ok, u IN ('Km²', 'Taxa - %') AS unit_ok, CASE WHEN good_f THEN f ELSE '' END AS kept_sources,
      array_to_string(list_filter([CASE WHEN NOT good_f AND f <> '' THEN 'fontes_shape' END, CASE WHEN d = '2026-02-31' THEN 'date_shape' END], lambda w: w IS NOT NULL), ',') AS warnings FROM y
    """,
)
def shape_validators(t):
    k = F.col("doc_id") % 4
    f = F.when(k == 0, F.concat_ws(", ", "source", "lang")).when(k == 1, F.col("text")).when(k == 2, "").otherwise(F.concat("source", F.lit(" a b c d e f g h i j k l m n")))
    u = F.when(k == 0, "Km²").when(k == 1, "a|b").when(k == 2, "12 345").otherwise("Taxa - %")
    d = F.when(F.col("doc_id") % 3 == 0, "2026-02-31").otherwise("2000-01-01")
    x = t.documents.select("doc_id", f.alias("f"), u.alias("u"), d.alias("d")).withColumn("good", T.plausible_sources(F.col("f")))
    warn = F.array_compact(F.array(F.when(~F.col("good") & (F.col("f") != ""), "fontes_shape"), F.when(~D.valid_date(F.col("d"), TODAY), "date_shape")))
    return x.select("doc_id", F.col("good").alias("sources_ok"), T.plausible_unit(F.col("u")).alias("unit_ok"), F.when(F.col("good"), F.col("f")).otherwise("").alias("kept_sources"), F.array_join(warn, ",").alias("warnings"))


@query(
    "q73_language_choice",
    "SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN lang WHEN doc_id % 3 = 0 THEN 'fr' WHEN doc_id % 3 = 1 THEN 'de' ELSE 'en' END AS chosen FROM documents",
)
def language_choice(t):
    from ..operators import search as S

    stored = F.when(F.col("doc_id") % 3 == 0, "fr").when(F.col("doc_id") % 3 == 1, "xx")
    browser = F.when(F.col("doc_id") % 3 == 1, "de").otherwise("yy")
    return t.documents.select("doc_id", S.choose_language(F.col("lang"), stored, browser, known=("fr", "de")).alias("chosen"))


@query(
    "q88_unit_capture",
    """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Taxa - %' WHEN 1 THEN 'Euro (a partir de 1/1/1999) - Média' ELSE '' END AS unit FROM documents
    """,
)
def unit_capture(t):
    caption = F.when(F.col("doc_id") % 3 == 0, "ver o gráfico ampliado Taxa - % ver tabela completa").when(F.col("doc_id") % 3 == 1, "ampliado Euro (a partir de 1/1/1999) - Média ver tabela comple ver tabela completa").otherwise("ampliado 12 345 678 ver tabela completa")
    slices = F.array(caption, F.lit("ampliado Euro (a partir de 1/1"), F.lit("tir de 1/1/1999) ver tabela completa"), F.col("text"))
    return t.documents.select("doc_id", P.first_mode(P.unit_candidates(slices)).alias("unit"))


@query(
    "q89_sentence_pick",
    """
    WITH s AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(10), 'g'), '\\n'), lambda x: trim(x)) AS s FROM documents),
    f AS (SELECT doc_id, list_filter(s, lambda x: length(x) BETWEEN 31 AND 599 AND regexp_matches(x, '(?i)the|der|les|que'))[1:12] AS f FROM s)
    SELECT doc_id, CAST(len(f) AS BIGINT) AS n, md5(array_to_string(f, '|')) AS picked, 'Os valores entre 2021 e 2024 foram revistos pelo organismo ' || doc_id || '.' AS revision,
      CASE WHEN doc_id % 2 = 0 THEN 'Quantos residentes há em CO₂?' ELSE '' END AS question FROM f
    """,
)
def sentence_pick(t):
    picked = P.sentences_with(F.col("text"), "(?i)the|der|les|que")
    window = F.concat(F.lit("As revistas são lidas? Fontes/Entidades: X Última actualização: 2024-01-05 Os valores entre 2021 e 2024 foram revistos pelo organismo "), F.col("doc_id").cast("string"), F.lit(". Mais opções foram revistas."))
    html = F.when(F.col("doc_id") % 2 == 0, "<h2>Curta?</h2><h2 class='q'>Quantos residentes há em CO<sub>2</sub> ?</h2>").otherwise("<h2>Sem pergunta nenhuma aqui</h2>")
    return t.documents.select("doc_id", F.size(picked).cast("long").alias("n"), F.md5(F.array_join(picked, "|")).alias("picked"), P.revision_of(window).alias("revision"), P.question_of(html).alias("question"))


@query(
    "q90_loose_redaction",
    "SELECT doc_id, md5(regexp_replace(text, '\\d[\\d.,  ]*\\d|\\d', '<number>', 'g')) AS masked FROM documents",
)
def loose_redaction(t):
    return t.documents.select("doc_id", F.md5(T.mask_values(F.col("text"))).alias("masked"))


@query(
    "q91_template_fill",
    """
    SELECT p_partkey, '<b>' || p_name || '</b> &lt;' || p_brand || '&gt;' AS html, p_name || ' (' || p_brand || ')' AS filled,
      'Series ' || p_name || '.' || CASE WHEN p_size > 10 THEN ' Unit: ' || p_type || '.' ELSE '' END AS description FROM part
    """,
)
def template_fill(t):
    html = F.concat(F.lit("<b>"), T.escape_html(F.col("p_name")), F.lit("</b> "), T.escape_html(F.concat(F.lit("<"), "p_brand", F.lit(">"))))
    described = F.concat_ws(" ", F.concat(F.lit("Series "), "p_name", F.lit(".")), F.when(F.col("p_size") > 10, F.concat(F.lit("Unit: "), "p_type", F.lit("."))))
    return t.part.select("p_partkey", html.alias("html"), T.fill(F.lit("{name} ({brand})"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("filled"), described.alias("description"))


@query("q92_footnote_norm", "SELECT p_partkey, p_name || ' a' AS norm FROM part")
def footnote_norm(t):
    return t.part.select("p_partkey", T.strip_footnotes(F.concat(F.initcap("p_name"), F.lit(" (1)  Á (12)"))).alias("norm"))


@query(
    "q93_code_census",
    """
    WITH c AS (SELECT unnest(list_distinct(regexp_extract_all(upper(strip_accents(lower(text))), '\\b[A-Z]{2,4}TION\\b'))) AS code FROM documents)
    SELECT code, count(*) AS n, CASE WHEN starts_with(code, 'A') THEN 'xml' WHEN starts_with(code, 'I') THEN 'json' ELSE 'text' END AS format FROM c GROUP BY code
    """,
)
def code_census(t):
    found = F.array_distinct(F.regexp_extract_all(F.upper(T.fold(F.col("text"))), F.lit(r"\b[A-Z]{2,4}TION\b"), 0))
    shape = F.when(F.col("code").startswith("A"), F.concat(F.lit(" <"), "code")).when(F.col("code").startswith("I"), F.concat(F.lit("{"), "code")).otherwise(F.col("code"))
    return t.documents.select(F.explode(found).alias("code")).groupBy("code").agg(F.count("*").alias("n")).withColumn("format", T.sniff_format(shape))


@query(
    "q95_month_label",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/d' ELSE strftime(o_orderdate, '%b %Y') END AS label FROM orders",
)
def month_label(t):
    iso = F.when(F.col("o_orderkey") % 5 == 0, "n/d").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", D.month_year(iso).alias("label"))


@query(
    "q96_period_span",
    """
    WITH y AS (SELECT o_custkey, list(year(o_orderdate)) AS y FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN len(y) >= 2 THEN CAST(list_min(y) AS INT) END AS first_year, CASE WHEN len(y) >= 2 THEN CAST(list_max(y) AS INT) END AS last_year FROM y
    """,
)
def period_span(t):
    y = t.orders.groupBy("o_custkey").agg(F.collect_list(F.year("o_orderdate")).alias("y"))
    return y.select("o_custkey", D.period(F.col("y")).alias("p")).select("o_custkey", F.col("p.first").alias("first_year"), F.col("p.last").alias("last_year"))


@query(
    "q97_age_verdict",
    """
    WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS built, o_orderdate + INTERVAL (o_orderkey % 3) MINUTE AS expected,
      o_orderdate + INTERVAL (o_orderkey % 90) MINUTE AS clock, o_orderkey % 11 <> 0 AS up FROM orders)
    SELECT o_orderkey, CASE WHEN NOT up THEN 'unreachable' WHEN built IS NULL THEN 'broken' WHEN built < expected AND epoch(clock - expected) / 60 <= 30 THEN 'deploying'
      WHEN built < expected THEN 'behind' ELSE 'ok' END AS verdict FROM x
    """,
)
def age_verdict(t):
    day = F.col("o_orderdate").cast("timestamp")
    minutes = lambda n: F.timestamp_seconds(F.unix_timestamp(day) + F.col("o_orderkey") % n * 60)
    built = D.parse_stamp(F.when(F.col("o_orderkey") % 6 == 0, "yesterday").otherwise(F.date_format(day, "yyyy-MM-dd HH:mm")))
    return t.orders.select("o_orderkey", D.age_verdict(built, minutes(3), minutes(90), F.col("o_orderkey") % 11 != 0).alias("verdict"))


@query(
    "q107_contrast_ratio",
    """
    WITH v(id, l, c, h, a) AS (VALUES (1, 0.2::DOUBLE, 0.05::DOUBLE, 250::DOUBLE, 1::DOUBLE), (2, 0.55, 0.12, 30, 0.75), (3, 0.7, 0.2, 140, 0.3)),
    p AS (SELECT id, a, l + 0.3963377774 * c * cos(radians(h)) + 0.2158037573 * c * sin(radians(h)) AS x, l - 0.1055613458 * c * cos(radians(h)) - 0.0638541728 * c * sin(radians(h)) AS y,
      l - 0.0894841775 * c * cos(radians(h)) - 1.291485548 * c * sin(radians(h)) AS z FROM v),
    r AS (SELECT id, a, 4.0767416621 * x**3 - 3.3077115913 * y**3 + 0.2309699292 * z**3 AS r, -1.2684380046 * x**3 + 2.6097574011 * y**3 - 0.3413193965 * z**3 AS g,
      -0.0041960863 * x**3 - 0.7034186147 * y**3 + 1.707614701 * z**3 AS b FROM p),
    m AS (SELECT id, 0.2126 * least(1, greatest(0, r * a + (4.0767416621 - 3.3077115913 + 0.2309699292) * (1 - a))) + 0.7152 * least(1, greatest(0, g * a + (-1.2684380046 + 2.6097574011 - 0.3413193965) * (1 - a)))
      + 0.0722 * least(1, greatest(0, b * a + (-0.0041960863 - 0.7034186147 + 1.707614701) * (1 - a))) AS f FROM r),
    w AS (SELECT 0.2126 * least(1, 4.0767416621 - 3.3077115913 + 0.2309699292) + 0.7152 * least(1, -1.2684380046 + 2.6097574011 - 0.3413193965) + 0.0722 * least(1, -0.0041960863 - 0.7034186147 + 1.707614701) AS w)
    SELECT CAST(id AS INT) AS id, round((greatest(f, w) + 0.05) / (least(f, w) + 0.05), 6) AS ratio FROM m, w
    """,
)
def contrast_ratio(t):
    v = t.spark.createDataFrame([(1, 0.2, 0.05, 250.0, 1.0), (2, 0.55, 0.12, 30.0, 0.75), (3, 0.7, 0.2, 140.0, 0.3)], "id int, l double, c double, h double, a double")
    white = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    return v.select("id", F.round(H.contrast([F.col("l"), F.col("c"), F.col("h")], white, F.col("a")), 6).alias("ratio"))


@query("q109_prefer_present", "SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AS recoverable FROM documents")
def prefer_present(t):
    windows = F.create_map(F.lit("a"), F.array("text"), F.lit("b"), F.array(F.lit("x")))
    body = F.array_join(P.slices_of(windows), " ")
    return t.documents.select("doc_id", (body.rlike("the") & body.rlike("and")).alias("recoverable"))
