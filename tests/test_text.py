"""Text, date and hash scalars on the truth tables and both sides of every
constant."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalyte.functions import dates as D
from catalyte.functions import hashing as H
from catalyte.functions import text as T
from catalyte.functions import urls as U

L = F.lit


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Índice de Gini", "indice de gini"), ("ÉÊÇßñ", "eecßn"), ("Å̊ á", "a a"), ("", ""), (None, ""), ("İstanbul", "istanbul")],
)
def test_fold(one, raw, want):
    assert one(T.fold(L(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("A ? B ? C", "A – B – C"), ("Onde existem mais vilas?", "Onde existem mais vilas?"), ("a ? ", "a ? ")])
def test_fix_separator(one, raw, want):
    assert one(T.fix_separator(L(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("x 1 234 567 y", "x y"), ("x 1.234 y", "x y"), ("3,5 a", "a"), ("2026-01-06", "2026-01-06"), ("1/1/1999", "1/1/1999"), ("em 2021", "em 2021"), ("por 1000", "por 1000"), ("-3,25 b", "b")],
)
def test_redact(one, raw, want):
    assert one(T.redact_values(L(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Casamentos: total e por sexo", ("Casamentos", "total e por sexo")),
        ("Dívida: em % do PIB", ("Dívida: em % do PIB", "")),
        ("Acidentes: por mil habitantes", ("Acidentes: por mil habitantes", "")),
        ("a: b: por sexo", ("a: b: por sexo", "")),
        ("População: homens e mulheres", ("População", "homens e mulheres")),
    ],
)
def test_breakdown(one, raw, want):
    title, tail = T.split_breakdown(L(raw))
    assert (one(title), one(tail)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("PIB < 5% (2020 > 2021)", "PIB < 5% (2020 > 2021)"), ("<em>per capita</em> x", "per capita x"), ("CO<sub>2</sub>", "CO₂"), ("km<sup>2</sup> <sup>10</sup>", "km² ¹⁰")],
)
def test_markup(one, raw, want):
    assert one(T.strip_tags(T.unicode_digits(L(raw)))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ABC (a partir de 2001)", "ABC"), ("DGX/MIN", "DGX"), ("Long name (ETC/BD)", "Long name (ETC/BD)"), ("ABC - total", "ABC")],
)
def test_source_org(one, raw, want):
    assert one(T.source_org(L(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("Km²", True), ("x" * 90, True), ("x" * 91, False), (" ".join("abcdefghijkl"), True), (" ".join("abcdefghijklm"), False), ("", False), ("a|b", False), ("1234567abcdefghijklm", True), ("12345678abcdefghijklm", False)])
def test_unit_shape(one, raw, want):
    assert one(T.plausible_unit(L(raw))) is want


@pytest.mark.parametrize(("raw", "want"), [("a" * 90, True), ("a" * 91, False), ("a," * 100, True), ("a," * 100 + "b", False), ("", False), (" ".join("a" * 14), True), (" ".join("a" * 15), False)])
def test_sources_shape(one, raw, want):
    assert one(T.plausible_sources(L(raw))) is want


@pytest.mark.parametrize(
    ("day", "want"),
    [("1990-01-01", True), ("1989-12-31", False), ("2026-09-17", True), ("2026-09-18", False), ("2026-02-31", False), ("2026-1-1", False), ("", False), (None, False)],
)
def test_valid_date(one, day, want):
    assert one(D.valid_date(L(day).cast("string"), "2026-09-15")) is want


@pytest.mark.parametrize(
    ("harvested", "stored", "now", "want"),
    [
        ("08-22", "08-20", "08-22", True),
        ("08-22", "08-22", "08-22", False),
        ("08-22", "08-20", "08-25", True),
        ("08-22", "08-20", "08-20", False),
        ("08-22", "08-20", "08-10", True),
        ("08-22", None, "08-25", True),
        ("08-22", None, "08-20", False),
        ("08-22", None, "08-22", False),
        ("08-22", "", "08-25", True),
        ("08-22", None, None, False),
        ("08-22", None, "", False),
        (None, None, "08-25", False),
    ],
)
def test_freshness(one, harvested, stored, now, want):
    text = lambda v: L(v).cast("string")
    assert one(D.is_stale(text(harvested), text(stored), text(now))) is want


@pytest.mark.parametrize(("years", "want"), [([1960, 2035], (1960, 2035)), ([1959, 2035], None), ([2000], None), ([2001, 2036, 1999], (1999, 2001)), ([], None)])
def test_period(one, years, want):
    row = one(D.period(F.array(*map(F.lit, years)).cast("array<int>")))
    assert (tuple(row) if row else None) == want


def test_fnv(one):
    assert one(H.fnv1a(7, L("portugal/1"))) == 660771164


def test_contrast(one):
    black, white = [L(0.0)] * 3, [L(1.0), L(0.0), L(0.0)]
    assert one(H.contrast(black, white, L(1.0))) == pytest.approx(21, abs=0.01)
    assert one(H.contrast(black, white, L(0.0))) == pytest.approx(1)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.h.org/a/x-999", True),
        ("https://h.org/a/x-999", True),
        ("https://evil.example/redir?u=h.org/a/x-999", False),
        ("javascript:h.org/a/x-1", False),
        ("http://h.org/a/x-1", False),
        ("https://user@h.org:443/a/x-1", True),
        ("https://nh.org/a/x-1", False),
        ("https://h.org/c/x-1", False),
        ("https://h.org/a/en/x-1", False),
        ("https://h.org/a/quadro+resumo-1", False),
        ("https://h.org/a/x", False),
    ],
)
def test_listed_page(one, url, want):
    assert one(U.is_listed_page(L(url), "h.org", ["a", "b"])) is want
