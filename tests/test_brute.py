"""Queries that SQL cannot say, against plain Python over the whole tables."""

from __future__ import annotations

import gzip
import re
from collections import defaultdict

import pytest

from catalyte.functions import text as T
from catalyte.operators import pages as P
from catalyte.plans import registry

from .conftest import TINY

QUERIES = registry.queries()


def table(spark, name: str, *columns: str) -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{TINY}/{name}.parquet").select(*columns).collect()]


def rows(spark, name: str) -> list:
    return QUERIES[name](spark, TINY).collect()


def name_words(name: str) -> set[str]:
    found = [w for w in re.sub(r"[^\w\s%€]", " ", name.lower().replace("-", "")).split() if len(w) >= 2 and w not in T.STOPWORDS_NAMES]
    return {w[:-1] if len(w) > 3 and w.endswith("s") else w for w in found}


def test_injective_match(spark):
    part = table(spark, "part", "p_partkey", "p_name", "p_type", "p_brand")
    pool: dict = {}
    for key, name, kind, _ in part:
        full = f"{name} {kind.lower()}"
        pool[full] = min(key, pool.get(full, key))
    names = sorted({f"{name} — {brand.lower()}" for _, name, _, brand in part})
    edges = []
    for name in names:
        wanted = name_words(name.split(" — ")[0])
        for full, key in pool.items():
            has = name_words(full)
            if wanted and wanted <= has and len(has - wanted) <= 2 and not (has - wanted) & set(T.CONTRAST):
                edges.append((len(has - wanted), name, key))
    place = {n: k for k, n in enumerate(sorted(names, reverse=True))}
    want, used = {}, set()
    for _, name, key in sorted(edges, key=lambda e: (e[0], place[e[1]], e[2])):
        if name not in want and key not in used:
            want[name] = key
            used.add(key)
    assert {r["name"]: r["id"] for r in rows(spark, "q61_injective_match")} == want and len(want) > 30


def test_synonym_collapse(spark):
    titles, series = defaultdict(set), defaultdict(int)
    for _, name, brand in table(spark, "part", "p_partkey", "p_name", "p_brand"):
        title = " ".join(re.findall("[a-z0-9]+", f"{name} {brand}".lower()))
        for w in {w for w in re.split("[^a-z0-9]+", f"{name} {brand}".lower()) if len(w) > 2 or w.isdigit()}:
            if not w.isdigit():
                titles[w].add(title)
                series[w] += 1
    open_words = sorted((w for w in titles if series[w] >= 8), key=lambda w: (-len(titles[w]), -series[w], w))
    kept: list[str] = []
    also = defaultdict(list)
    for w in open_words:
        host = next((h for h in kept if len(titles[w] & titles[h]) >= 0.9 * len(titles[w])), None)
        if host is None:
            kept.append(w)
        else:
            also[host].append(w)
    got = {r["token"]: r["also"] for r in rows(spark, "q64_synonym_collapse")}
    assert got == {w: ",".join(also[w]) for w in kept}


def test_marker_windows(spark):
    want = []
    for doc, text in table(spark, "documents", "doc_id", "text"):
        if text is None:
            continue
        text = "12 345 Fontes/Entidades: X 1,5 " + text
        for marker in ("Fontes", "tion", "de"):
            at, spans = -1, []
            while len(spans) < 3 and (at := text.find(marker, at + 1)) >= 0:
                spans.append(text[max(0, at - 60) : at + len(marker) + 220])
                at += len(marker) - 1
            for pos, span in enumerate(spans):
                bare = re.sub(T.VALUE_TOKEN, "", span, flags=re.A)
                want.append((doc, marker, pos, re.sub(r"\s{2,}", " ", bare, flags=re.A).strip(" ")))
    got = [(r["doc_id"], r["marker"], r["pos"], r["excerpt"]) for r in rows(spark, "q55_marker_windows")]
    assert sorted(got) == sorted(want)


def test_page_years(spark):
    want = defaultdict(int)
    for page, html in table(spark, "pages", "page_id", "html"):
        html += "<p>1999 <b>from 2001</b></p><i>2004</i>"
        for m in re.finditer(r"<([a-z0-9]+)[^<>]*>[^<>]*?\b((?:19|20)\d\d)\b", html, re.I | re.A):
            want[page, m[1].lower(), int(m[2])] += 1
    assert {(r["page_id"], r["holder"], r["year"]): r["n"] for r in rows(spark, "q57_page_years")} == want


def test_featured_lines(spark):
    lines = {r["page_id"]: list(r["l"]) for r in spark.read.parquet(f"{TINY}/pages.parquet").select("page_id", P.lines_of(P.F.col("html")).alias("l")).collect()}
    want = [(page, at, name) for page, own in lines.items() for at, name in enumerate(P.featured_names(own))]
    assert sorted((r["page_id"], r["pos"], r["name"]) for r in rows(spark, "q57_featured_lines")) == sorted(want)


def test_payload_gzip(spark):
    want = {doc: len(gzip.compress((text or "").encode(), 9, mtime=0)) / 1024 for doc, text in table(spark, "documents", "doc_id", "text")}
    for r in rows(spark, "q101_payload_gzip"):
        assert r["kb"] == pytest.approx(want[r["doc_id"]]) and r["within"] == (want[r["doc_id"]] <= 250)
