"""Catalogue search: prepared rows, graded term matches, stable orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T


def prepare(df: DataFrame, name: str, others: list[str], lists: list[str] = ()) -> DataFrame:
    """Adds _name, _hay and _words (distinct, over one character)."""
    parts = [F.coalesce(F.col(name), F.lit("")), *(F.coalesce(F.col(c), F.lit("")) for c in others), *(F.array_join(c, " ") for c in lists)]
    hay = T.fold(F.concat_ws(" ", *parts))
    words = F.array_distinct(F.filter(F.split(F.col("_hay"), "[^a-z0-9%€]+"), lambda w: F.length(w) > 1))
    return df.withColumn("_name", T.fold(F.col(name))).withColumn("_hay", hay).withColumn("_words", words)


def term_score(term: str) -> Column:
    """3 in the name, 2 elsewhere, 1 within the term's typo budget, 0."""
    budget = 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0
    close = F.lit(False)
    if budget:
        gap = lambda w: F.abs(F.length(w) - len(term)) <= budget
        close = F.exists("_words", lambda w: gap(w) & (F.levenshtein(F.lit(term), w, budget) >= 0))
    return F.when(F.contains("_name", F.lit(term)), 3).when(F.contains("_hay", F.lit(term)), 2).when(close, 1).otherwise(0)


def fold_query(query: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return plain.split()


def scored(prepared: DataFrame, query: str, areas: list[str] = (), area: str = "area", featured: str | None = None) -> DataFrame:
    """Rows that match every term, with score = 1 + the sum over terms; a row
    that misses a term goes. ``areas`` (any, if empty) and a non-empty
    ``featured`` list filter first."""
    out = prepared
    if areas:
        out = out.where(F.col(area).isin(list(areas)))
    if featured:
        out = out.where(F.coalesce(F.size(featured), F.lit(0)) > 0)
    total = F.lit(1)
    for k, term in enumerate(fold_query(query)):
        out = out.withColumn(f"_t{k}", term_score(term)).where(F.col(f"_t{k}") > 0)
        total = total + F.col(f"_t{k}")
    return out.withColumn("score", total).drop(*(f"_t{k}" for k in range(len(fold_query(query)))))


def order_columns(mode: str, name: Column, date: Column | None = None, sources: Column | None = None, key: Column | None = None, seed: int = 7) -> list[Column]:
    """Sort keys of a mode; every one ends in the name."""
    dated = F.nullif(date, F.lit("")) if date is not None else None
    if mode == "az":
        return [name.asc()]
    if mode == "za":
        return [name.desc()]
    if mode == "new":
        return [dated.desc_nulls_last(), name.asc()]
    if mode == "old":
        return [dated.asc_nulls_last(), name.asc()]
    if mode in ("srcFew", "srcMany"):
        count = F.coalesce(sources, F.lit(0))
        return [count.asc() if mode == "srcFew" else count.desc(), dated.desc_nulls_last(), name.asc()]
    if mode == "random":
        return [H.fnv1a(seed, key).asc(), name.asc()]
    raise ValueError(f"no order {mode}")


def display_name(name: Column, name_en: Column, lang: str) -> tuple[Column, Column]:
    """The name in the chosen language, and the other one where it differs."""
    first, second = (name_en, name) if lang == "en" else (name, name_en)
    shown = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit(""))
    return shown, F.when(F.coalesce(second, F.lit("")) != shown, F.nullif(second, F.lit("")))


def choose_language(*candidates: Column, known: tuple[str, ...] = ("pt", "en"), default: str = "en") -> Column:
    return F.coalesce(*(F.when(c.isin(list(known)), c) for c in candidates), F.lit(default))


def search(prepared: DataFrame, query: str = "", areas: list[str] = (), mode: str = "az", lang: str = "pt", summary_only: bool = False, seed: int = 7, offset: int = 0, limit: int | None = None, collation: str = "pt") -> DataFrame:
    """The whole search: filters, graded match, order, page. Expects area, id,
    name, name_en, updated, sources (array), featured (array)."""
    shown, _ = display_name(F.col("name"), F.col("name_en"), lang)
    hits = scored(prepared, query, areas, featured="featured" if summary_only else None)
    key = F.concat_ws("/", F.col("area"), F.col("id").cast("string"))
    out = hits.orderBy(*order_columns(mode, F.collate(shown, collation), F.col("updated"), F.size("sources"), key, seed), "area", "id")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out
