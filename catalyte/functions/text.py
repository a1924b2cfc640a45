"""Text scalars: Column in, Column out, all JVM-side."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the matching rules.
STOPWORDS_EN = (
    "the of and by in to for on at as a an or with from per total data statistics annual quarterly monthly number rate other all"
).split()
STOPWORDS_PT = "de da do das dos e em no na nos nas por a o as os com para total ao aos um uma que".split()
STOPWORDS_NAMES = "de da do das dos e em no na nos nas por para a o os as com que total % €".split()
DERIVATION = (
    "proporcao percentagem taxa indice racio media mediana densidade variacao capita peso quota medio mediano percentual"
).split()
NEGATION = "nao sem exceto excepto excluindo fora".split()
CONTRAST = (
    "ante apo homen mulhere feminina masculina longa densidade concentracao dissolvido morte dependencia credito desigualdade"
).split()
UNIT_GROUPS = "euro|percentage|pps|euro ecu|eu27 100|at current prices|[0-9]{4}[^)]*|nace[^)]*|isced[^)]*"
TAIL_TOTAL_BY = r"(?i)\s*[:,]?\s*\b(?:total and by|and by|by)\b"
TAIL_BY = r"(?i)\s*,?\s*\bby\b"
PER_UNIT = r"\bpor\s+(mil|cem|100|1000|habitante)"
DIMENSION_LIST = (
    r"(?iU)^(total\s+e\s+por\b|total,\s|total\s+e\s+|por\s+(?!cem|mil|100|habitante)\w|homens\s+e\s+mulheres\b|\w+\s+e\s+\w+\s+por\b)"
)
VALUE_TOKEN = r"(?<![\d,./-])\d{1,3}(?:[ .]\d{3})+(?![\d,./-])|(?<![\d,./-])-?\d+,\d+(?![\d,./-])"
SOURCE_BOUNDARY = (
    r"Carregue|ver tabela|ver o gráfico|Última|Ultima|Consulte|©|Fontes?\s*/\s*Entidades|Operações|Opções|Ver Gráfico|Ranking|Simbologia|Exportar"
)
YEAR_QUALIFIER = r"\s*\([^)]*\b(?:19|20)\d\d\b[^)]*\)\s*$"
MAX_SOURCE, MAX_SOURCE_PART, MAX_SOURCE_WORDS = 200, 90, 14
MAX_UNIT, MAX_UNIT_WORDS, MAX_UNIT_DIGITS = 90, 12, 0.35
SUPERSCRIPTS, SUBSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"


def _folding() -> tuple[str, str]:
    """Latin letters whose decomposition is one letter and marks, then the
    marks themselves, which ``translate`` drops."""
    pairs = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    marks = "".join(chr(c) for c in range(0x0300, 0x0370) if unicodedata.category(chr(c)) == "Mn")
    return "".join(pairs) + marks, "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def fold(c: Column) -> Column:
    """Lower case without accents (Latin letters and combining marks)."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def bare_title(c: Column) -> Column:
    """``norm_title`` without a short last parenthesis."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"\s*\([^)]{1,12}\)\s*$", ""), "[^a-z0-9]+", " "))


def split_words(c: Column) -> Column:
    return F.split(fold(c), "[^a-z0-9]+")


def content_words(c: Column, stopwords: list[str] = STOPWORDS_PT) -> Column:
    """Distinct content words in order: over two characters or all digits, and
    no stopword."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else None

    def keep(w: Column) -> Column:
        good = (F.length(w) > 2) | w.rlike("^[0-9]+$")
        return good & ~F.array_contains(stop, w) if stop is not None else good

    return F.array_distinct(F.filter(split_words(c), keep))


def head_word(c: Column, stopwords: list[str] = STOPWORDS_PT) -> Column:
    return F.try_element_at(content_words(c, stopwords), F.lit(1))


def norm_name(c: Column) -> Column:
    """Folded, hyphens closed, all but letters, digits, _, % and € to spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(fold(c), F.lit("-"), F.lit("")), r"(?U)[^\w\s%€]", " "), r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """Distinct name words, sorted, with a crude plural cut."""
    words = F.filter(F.split(norm_name(c), " "), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS_NAMES))
    stem = lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_sort(F.array_distinct(F.transform(words, stem)))


def strip_unit(c: Column) -> Column:
    """Without the listed unit or period parentheses at the end."""
    return F.trim(F.regexp_replace(c, rf"(?i)(?:\s*\((?:{UNIT_GROUPS})\))+\s*$", ""))


def split_tail(c: Column, pattern: str = TAIL_BY) -> tuple[Column, Column]:
    """The concept, and the phrase from the first match of ``pattern`` on."""
    head = F.regexp_replace(c, pattern + r"(?s).*$", "")
    return F.trim(head), F.trim(F.substring(c, F.length(head) + 1, F.length(c)))


def before_dash(c: Column) -> Column:
    return F.trim(F.split(c, r"\s+[—–-]\s+", 2)[0])


def split_breakdown(c: Column) -> tuple[Column, Column]:
    """(title, breakdown) at the one colon, if what follows lists dimensions."""
    parts = F.split(c, ":", 2)
    head, tail = F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))
    ok = (F.regexp_count(c, F.lit(":")) == 1) & (head != "") & tail.rlike(DIMENSION_LIST)
    return F.when(ok, head).otherwise(c), F.when(ok, tail).otherwise("")


CATEGORY = r"^([^:]{2,40}):\s*(.+)$"


def category_head(c: Column) -> Column:
    """The folded part before a colon, or null."""
    return F.when(c.rlike(CATEGORY), F.trim(fold(F.regexp_extract(c, CATEGORY, 1))))


def category_tail(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, CATEGORY, 2))


def unicode_digits(c: Column) -> Column:
    """Digits in sub and sup elements as their Unicode forms; runs of up to four
    digits by one replacement each."""
    for tag, forms in (("sup", SUPERSCRIPTS), ("sub", SUBSCRIPTS)):
        for _ in range(4):  # one digit a pass, from the left, through a private mark
            for digit, form in zip("0123456789", forms, strict=True):
                c = F.regexp_replace(c, rf"<{tag}>([{forms}]*){digit}(\d*)</{tag}>", rf"<{tag}>$1{form}$2</{tag}>")
        c = F.regexp_replace(c, rf"<{tag}>([{forms}]+)</{tag}>", "$1")
    return c


def strip_tags(c: Column) -> Column:
    """Without real tags; a bare comparison sign stays."""
    return collapse(F.regexp_replace(c, TAG, ""))


ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _entity(token: Column) -> Column:
    """The character that one character reference stands for; an unknown name
    stays, a number that is no character is the replacement character."""
    names = {k: " " if k == "nbsp" else chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'"}
    # Numbers from 128 to 159 mean what they mean in windows-1252.
    odd = {k: bytes([k]).decode("cp1252", "replace") for k in range(128, 160)} | {160: " "}
    table = lambda d: F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*map(F.lit, d.values())))
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    digits = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.length(body)))
    code = F.when(body.startswith("#"), digits.try_cast("int"))
    fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table(odd), code), plain)).otherwise(F.coalesce(F.try_element_at(table(names), body), token))


def unescape(c: Column) -> Column:
    """Character references (named ones of HTML 4, decimal, hexadecimal, with
    their semicolon) as characters, in one pass; a no-break space as a space."""
    pieces, tokens = F.split(c, ENTITY, -1), F.regexp_extract_all(c, F.lit(ENTITY), 0)
    mixed = F.zip_with(pieces, F.transform(tokens, _entity), lambda p, e: F.concat(p, F.coalesce(e, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")) & c.rlike(ENTITY), F.array_join(mixed, "")).otherwise(c)


def page_text(c: Column) -> Column:
    """Visible text of a page: script and style bodies and tags dropped."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.regexp_replace(unescape(F.regexp_replace(bare, r"<[^>]+>", " ")), r"\s+", " ")


def name_from_title(c: Column, suffix: str, prefixes: list[str]) -> Column:
    """The name in "<prefix>: <name> | <suffix>", or "" without the suffix."""
    end = rf"\s*\|\s*{suffix}\s*$"
    name = F.regexp_replace(F.regexp_replace(c, end, ""), rf"^({'|'.join(prefixes)}):\s*", "")
    return F.when(c.rlike(rf"\|\s*{suffix}\s*$"), F.trim(name)).otherwise("")


def clean_sources(c: Column) -> Column:
    return F.btrim(F.split(c, SOURCE_BOUNDARY, 2)[0], F.lit(" ,;|-"))


def split_sources(c: Column) -> Column:
    """Distinct trimmed parts, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(clean_sources(c), r"[|,;]"), lambda p: F.trim(p)), lambda p: p != ""))


def source_org(c: Column) -> Column:
    """The organisation: before " - ", without a year qualifier, cut at a slash
    outside parentheses."""
    head = F.trim(F.regexp_replace(F.trim(F.split(c, " - ", 2)[0]), YEAR_QUALIFIER, ""))
    outside = F.split(head, r"\(", 2)[0]
    return F.when(F.contains(outside, F.lit("/")), F.trim(F.split(outside, "/", 2)[0])).otherwise(head)


def source_orgs(c: Column, universal: str | None = None) -> Column:
    orgs = F.array_distinct(F.filter(F.transform(c, source_org), lambda o: o != ""))
    return F.array_remove(orgs, universal) if universal else orgs


def fix_separator(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\S) \? (?=\S)", " – ")


def restore_acronyms(name: Column, evidence: Column) -> Column:
    """Capitals of ``evidence``'s acronyms put back into ``name``."""
    found = F.array_distinct(F.regexp_extract_all(evidence, F.lit(r"\b[A-Z][A-Z0-9]+\b"), 0))
    return F.aggregate(found, name, lambda acc, a: F.regexp_replace(acc, F.concat(F.lit(r"\b"), F.lower(a), F.lit(r"\b")), a))


def name_from_slug(c: Column) -> Column:
    """The last path segment without its id, pluses as spaces, first letter
    upper."""
    slug = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"-\d+$", "")
    text = collapse(F.replace(F.coalesce(F.try_url_decode(slug), slug), F.lit("+"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def derivation_markers(c: Column) -> Column:
    words = F.array_intersect(content_words(c), F.array(*map(F.lit, DERIVATION)))
    per = F.when(fold(c).rlike(PER_UNIT), F.array(F.lit("per"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.concat(words, per))


def unit_markers(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    marks = F.array(F.when(F.contains(c, F.lit("%")), "pct"), F.when(F.contains(c, F.lit("‰")), "permil"))
    return F.array_compact(marks)


def trailing_unit(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\(([^)]*)\)\s*$", 1)


def negations(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold(c), F.lit(rf"\b({'|'.join(NEGATION)})\b"), 1)))


def redact_values(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, VALUE_TOKEN, ""), r"\s{2,}", " "))


def mask_values(c: Column) -> Column:
    return F.regexp_replace(c, r"\d[\d.,  ]*\d|\d", "<number>")


def digit_ratio(c: Column) -> Column:
    """Share of ASCII digits."""
    return F.try_divide(F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double"), F.length(c))


def plausible_unit(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    short = (F.length(c) > 0) & (F.length(c) <= MAX_UNIT) & (F.regexp_count(c, F.lit(r"\S+")) <= MAX_UNIT_WORDS)
    return short & (digit_ratio(c) <= MAX_UNIT_DIGITS) & ~c.rlike("[|:\n]")


def plausible_sources(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    parts = F.transform(F.split(c, r"[|,;]"), lambda p: F.trim(p))
    fine = F.forall(parts, lambda p: (F.length(p) <= MAX_SOURCE_PART) & (F.regexp_count(p, F.lit(r"\S+")) <= MAX_SOURCE_WORDS))
    return (F.length(c) > 0) & (F.length(c) <= MAX_SOURCE) & fine


def short_sources(sources: Column) -> Column:
    """The first source's short form and how many more there are."""
    first = F.split(F.try_element_at(sources, F.lit(1)), " - ", 2)[0]
    more = F.coalesce(F.size(sources), F.lit(0)) - 1
    return F.when(more > 0, F.concat(first, F.lit(" +"), more.cast("string"))).otherwise(F.coalesce(first, F.lit("")))


def escape_html(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with {key} places."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value.cast("string"))
    return template


def strip_footnotes(c: Column) -> Column:
    """Folded, without footnote marks such as (1) at the end of words."""
    return collapse(F.regexp_replace(fold(c), r"\s*\(\d{1,2}\)", ""))


def sniff_format(c: Column) -> Column:
    start = F.ltrim(c)
    return F.when(start.startswith("<"), "xml").when(start.rlike(r"^[\[{]"), "json").when(F.contains(c, F.lit("\t")), "tsv").otherwise("text")


def present(c: Column, kind: str = "string") -> Column:
    """Neither null nor empty: what counts as a value in coverage figures."""
    if kind.startswith("array") or kind.startswith("map"):
        return F.coalesce(F.size(c), F.lit(0)) > 0
    if kind == "string":
        return F.coalesce(c, F.lit("")) != ""
    return c.isNotNull()


def phrase_of(title: Column, name: Column) -> Column:
    """The title, or the name where the title is missing or empty."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(name, F.lit("")), F.lit(""))


def sentences(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, r"\s+", " "), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
