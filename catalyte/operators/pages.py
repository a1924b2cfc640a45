"""Fields from pages and excerpts."""

from __future__ import annotations

import gzip
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

# Markers, captions and revision wording.
MARKERS = ["Fontes", "Entidades", "ltima atualiza", "ltima actualiza", "revis", "Unidade", "ampliado"]
UNIT_CAPTION = r"ampliado\s+(.{1,100}?)\s+ver tabela completa"
UNIT_RUNON = r"\s+(?:ver tabela|Carregue|\|\|)"
REVISION_EVENT = r"(?iU)\brevis(?:ão|ões)|(?:foram|foi|são|ser|sido)\s+revist|\brevist[oa]s?\s+(?:pel|em|entre|a partir)"
REVISION_CHROME = r"(?iU)Mais opções|Aprofunde|Carregue|ver tabela|Relacionados|Fontes/Entidades|A carregar"
REVISION_LEAD = r"(?s)^.*?(?:\d{4}-\d{2}-\d{2}|actualiza[^:]*:)\s*"
REVISION_MIN, REVISION_MAX = 25, 240
QUESTION_MIN, QUESTION_MAX = 15, 240
LEAF_MAX = 400
STOP_NAMES = {"simbologia", "exportar dados", "pdf", "excel", "todas", "videos", "livros", "quadro resumo", "quadros resumo"}
NAME_MIN, SUBTITLE_MIN = 10, 5
TITLE_TAG = r"(?s)<title[^>]*>(.*?)</title>"
HEADING_TAG = r"(?is)<h2[^>]*>(.*?)</h2>"
YEAR_SHOWN = r'(?i)class="[^"]*Year(?:Current|Other)Text[^"]*"[^>]*>\s*(\d{4})\s*<'
YEAR_PICKED = r'(?i)<option[^>]+value="(\d{4})"'
LINKED_DATA = r"(?s)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
DESCRIPTION = r'<meta\s+name="description"\s+content="([^"]*)"'
SOURCES = r"Fontes?\s*/\s*Entidades:?\s*(.{1,250})"
UPDATED = r"[ÚU]ltima\s+a[ct]+ualiza[çc][ãa]o:?\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
UPDATED_LOOSE = r"[ÚU]ltima\s+a[ct]+ualiza[çc][ãa]o:?\s*(.{1,30})"


def title_of(html: Column) -> Column:
    return F.trim(T.unescape(F.regexp_extract(html, TITLE_TAG, 1)))


def question_of(html: Column) -> Column:
    """The first second-level heading that reads as a question, or ""."""
    found = F.regexp_extract_all(T.unicode_digits(html), F.lit(HEADING_TAG), 1)
    clean = lambda x: F.regexp_replace(T.collapse(T.unescape(F.regexp_replace(x, r"<[^>]+>", " "))), r"\s+([?!.,;:])", "$1")
    good = F.filter(F.transform(found, clean), lambda x: x.endswith("?") & F.length(x).between(QUESTION_MIN, QUESTION_MAX))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def years_of(html: Column) -> Column:
    """Years named in year elements, else those of the year picker."""
    shown = F.regexp_extract_all(html, F.lit(YEAR_SHOWN), 1)
    picker = F.regexp_extract_all(html, F.lit(YEAR_PICKED), 1)
    return F.transform(F.when(F.size(shown) > 0, shown).otherwise(picker), lambda y: y.cast("int"))


def period_of(html: Column) -> Column:
    return D.period(years_of(html))


def json_ld_of(html: Column) -> Column:
    """The linked-data object, or {"unparsed": …} with its first 800 characters."""
    raw = F.regexp_extract(html, LINKED_DATA, 1)
    fallback = F.to_variant_object(F.named_struct(F.lit("unparsed"), F.substring(raw, 1, 800)))
    return F.when(raw != "", F.coalesce(F.try_parse_json(raw), fallback))


def lines_of(html: Column) -> Column:
    """Non-empty lines of the page's text: tags end a line."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    lines = F.split(T.unescape(F.regexp_replace(bare, r"<[^>]+>", "\n")), "\n")
    return F.filter(F.transform(lines, T.collapse), lambda x: x != "")


def record_of(pages: DataFrame, url: str, html: str, suffix: str, prefixes: list[str], today: str) -> DataFrame:
    """Harvest fields of each page. A field is a value, the shape it must have,
    and the warning that stands for it where it has another and becomes ""."""
    h, body, always = F.col(html), T.page_text(F.col(html)), F.lit(True)
    title = title_of(h)
    name = T.name_from_title(title, suffix, prefixes)
    sources = T.clean_sources(F.regexp_extract(body, SOURCES, 1))
    # A date of another shape is caught too, so that it warns.
    updated = F.coalesce(F.nullif(F.regexp_extract(body, UPDATED, 1), F.lit("")), F.trim(F.regexp_extract(body, UPDATED_LOOSE, 1)))
    fields = {
        "url": (F.col(url), always, None),
        "name": (name, (title == "") | (name != ""), "title_template"),
        "title": (title, always, None),
        "description": (F.regexp_extract(h, DESCRIPTION, 1), always, None),
        "fontes": (sources, (sources == "") | T.plausible_sources(sources), "fontes_shape"),
        "ultima_atualizacao": (updated, (updated == "") | F.coalesce(D.valid_date(updated, today), F.lit(False)), "date_shape"),
        "question": (question_of(h), always, None),
        "period": (period_of(h), always, None),
    }
    plain = [(c if label is None else F.when(good, c).otherwise("")).alias(k) for k, (c, good, label) in fields.items()]
    warned = F.array_compact(F.array(*(F.when(~good, label) for _, good, label in fields.values() if label)))
    return pages.select(*plain, warned.alias("parse_warnings"))


# --------------------------------------------------------------------------
# excerpts


def windows_of(text: str | None, words: list[str] = MARKERS, before: int = 60, after: int = 220, most: int = 3) -> dict[str, list[str]]:
    """The first excerpts around each marker, observation values removed. They
    may overlap, which one regular expression cannot say."""
    out = {}
    for word in words:
        spans = []
        for m in re.finditer(re.escape(word), text or ""):
            spans.append(text[max(0, m.start() - before) : m.end() + after])
            if len(spans) == most:
                break
        if spans:
            out[word] = spans
    return out


def marker_windows(text: Column, words: list[str] = MARKERS) -> Column:
    """map<marker, excerpts> of a text column; values removed JVM-side."""

    @F.pandas_udf("map<string,array<string>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: windows_of(t, words))

    return F.transform_values(cut(text), lambda _, spans: F.transform(spans, T.redact_values))


def slices_of(windows: Column) -> Column:
    return F.flatten(F.map_values(windows))


def unit_candidates(slices: Column) -> Column:
    """Plausible units in excerpts, each excerpt searched on its own."""
    found = F.flatten(F.transform(slices, lambda s: F.regexp_extract_all(s, F.lit(UNIT_CAPTION), 1)))
    trimmed = F.transform(found, lambda u: F.trim(F.split(T.collapse(u), UNIT_RUNON, 2)[0]))
    return F.filter(trimmed, T.plausible_unit)


def first_mode(values: Column) -> Column:
    """The most frequent element, of equals the first; "" without any."""
    distinct = F.array_distinct(values)
    count = lambda x: F.size(F.filter(values, lambda y: y == x))
    best = F.aggregate(distinct, F.struct(F.lit("").alias("v"), F.lit(0).alias("n")), lambda acc, x: F.when(count(x) > acc["n"], F.struct(x.alias("v"), count(x).alias("n"))).otherwise(acc))
    return best["v"]


def revision_of(window: Column) -> Column:
    """The first sentence that reports a revision, or ""."""

    def candidate(s: Column) -> Column:
        start = F.regexp_instr(s, F.lit(REVISION_EVENT)) - 1
        head = F.regexp_replace(F.substring(s, F.lit(1), start), REVISION_LEAD, "")
        return F.trim(F.regexp_replace(F.concat(head, F.substring(s, start + 1, F.length(s))), r"^[^A-Za-zÀ-Úà-ú]+", ""))

    hits = F.filter(T.sentences(window), lambda s: s.rlike(REVISION_EVENT) & ~s.endswith("?"))
    good = F.filter(F.transform(hits, candidate), lambda s: ~s.rlike(REVISION_CHROME) & F.length(s).between(REVISION_MIN, REVISION_MAX))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def sentences_with(text: Column, pattern: str, most: int = 12) -> Column:
    """Sentences of 31 to 599 characters that match, the first ``most``."""
    return F.slice(F.filter(T.sentences(text), lambda s: F.length(s).between(31, 599) & s.rlike(pattern)), 1, most)


def marker_counts(text: Column, markers: dict[str, str]) -> list[Column]:
    return [F.regexp_count(text, F.lit(re.escape(m))).alias(name) for name, m in markers.items()]


# --------------------------------------------------------------------------
# structure walks (one row to many)


class _Elements(HTMLParser):
    """The text of every element: what stands in it directly and in the inline
    elements within it, in order, so that inline markup does not cut a sentence.
    An end tag without its start is passed over; one that ends several unclosed
    elements ends them all."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    SKIP = frozenset(("script", "style", "noscript", "svg", "template"))
    INLINE = frozenset("a abbr b bdi bdo cite code em i kbd mark q s samp small span strong sub sup time u var".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, list[str]]] = []  # tag, label, hidden, texts
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            label = ".".join([tag, *(dict(attrs).get("class") or "").split()[:1]])
            hidden = tag in self.SKIP or bool(self.open and self.open[-1][2])
            self.open.append((tag, label, hidden, []))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data):
        if self.open and data.strip():
            self.open[-1][3].append(" ".join(data.split()))

    def close(self):
        super().close()
        while self.open:
            self._end()

    def _end(self) -> str:
        tag, label, hidden, texts = self.open.pop()
        text = " ".join(texts)
        if text and not hidden:
            if len(text) <= LEAF_MAX:  # longer ones are prose, no field
                self.found.append((label, re.sub(r"\d", "#", text)))
            if tag in self.INLINE and self.open:
                self.open[-1][3].append(text)
        return tag


def page_inventory(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, holder, text): the text of each element of up to ``LEAF_MAX``
    characters by tag and first class, digits masked."""

    def walk(batches):
        for pdf in batches:
            rows = []
            for k, body in zip(pdf["k"], pdf["h"], strict=True):
                parser = _Elements()
                parser.feed(body or "")
                parser.close()
                rows += [(k, *x) for x in parser.found]
            yield pd.DataFrame(rows, columns=["k", "holder", "text"])

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(walk, "k long, holder string, text string").withColumnRenamed("k", key)


def page_years(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, holder, year, n): years in the page by the element before them, each
    tag with the first year of the text that follows it."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<[a-z0-9]+[^<>]*>[^<>]*?\b(?:19|20)\d\d\b"), 0)
    spread = pages.select(F.col(key), F.explode(found).alias("m"))
    named = spread.select(key, F.lower(F.regexp_extract("m", r"(?i)^<([a-z0-9]+)", 1)).alias("holder"), F.right("m", F.lit(4)).cast("int").alias("year"))
    return named.groupBy(key, "holder", "year").agg(F.count("*").alias("n"))


def _plain_name(line: str) -> str:
    bare = unicodedata.normalize("NFD", re.sub(r"\(\d\)", "", line))
    return " ".join("".join(c for c in bare if not unicodedata.combining(c)).split()).lower()


def featured_names(lines: list[str]) -> list[str]:
    """Names in a summary table's lines, each once: a line that stands again
    within the next two (footnote marks aside), begins with a capital, is long
    enough and no caption of the page. Where name and subtitle alternate, the
    subtitle is added to the name."""
    plain, seen, out = [_plain_name(x) for x in lines], set(), []
    for at, own in enumerate(plain):
        again = own in plain[at + 1 : at + 3] and own not in seen and own not in STOP_NAMES
        if not again or len(own) < NAME_MIN or not lines[at][:1].isupper():
            continue
        seen.add(own)
        name = re.sub(r"\s*\(\d\)\s*$", "", lines[at]).strip()
        pattern = plain[at : at + 4]
        if len(pattern) == 4 and pattern[:2] == pattern[2:] and pattern[1] != own:
            subtitle = lines[at + 1].strip()
            if len(subtitle) >= SUBTITLE_MIN and not re.fullmatch(r"\(\d+\)", subtitle):
                name = f"{name} — {subtitle}"
                seen.add(pattern[1])
        out.append(name)
    return out


def featured_lines(pages: DataFrame, key: str, lines: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def names(s: pd.Series) -> pd.Series:
        return s.map(lambda x: featured_names(list(x)))

    return pages.select(key, F.posexplode(names(lines)).alias("pos", "name"))


# --------------------------------------------------------------------------
# exact Python fallbacks


def _string_udf(kind: str, f):
    """A vectorised function, made where it is used: a worker that imports this
    module has no session to make it in."""

    def work(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(work, kind)


def fold_exact(c: Column) -> Column:
    """``text.fold`` for every script, by full Unicode decomposition."""
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFD", (t or "").lower()) if unicodedata.category(x) != "Mn")
    return _string_udf("string", plain)(c)


def gzip_kb(c: Column) -> Column:
    """Size in KB after gzip, as a payload budget counts it."""
    return _string_udf("double", lambda t: len(gzip.compress((t or "").encode(), 9, mtime=0)) / 1024)(c)
