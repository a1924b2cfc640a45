"""URL predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_listed_page(url: Column, domain: str, sections: list[str] | None = None, barred: tuple[str, ...] = ("quadro+resumo",), scheme: str = "https", not_under: tuple[str, ...] = ("/en/",)) -> Column:
    """Whether a URL is an entry page: it ends in a numeric id, has the scheme,
    the host is ``domain`` or a subdomain, the first path segment is one of
    ``sections``, and no barred text occurs. A host is compared, not searched
    for, so a URL that only mentions the domain is refused."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    section = F.split(F.ltrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/")
    good = url.rlike(r"-\d+$") & (F.try_parse_url(url, F.lit("PROTOCOL")) == scheme) & ((host == domain) | host.endswith("." + domain))
    for text in (*barred, *not_under):
        good = good & ~F.contains(url, F.lit(text))
    if sections is not None:
        good = good & F.try_element_at(section, F.lit(2)).isin(sections)
    return F.coalesce(good, F.lit(False))


def section_and_id(url: Column, accepted: Column) -> tuple[Column, Column]:
    path = F.try_parse_url(url, F.lit("PATH"))
    section = F.when(accepted, F.try_element_at(F.split(path, "/"), F.lit(2)))
    return section, F.when(accepted, F.regexp_extract(path, r"-(\d+)$", 1).try_cast("long"))


def short_url(url: Column) -> Column:
    """A URL without scheme and host."""
    return F.regexp_replace(url, r"^[a-z]+://[^/]+/?", "")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
