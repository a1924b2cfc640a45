"""Near copies of the pipeline against brute-force Jaccard."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from catalyte.llm import common, simhash

from . import brute
from ..conftest import TINY


def graded() -> list[tuple[int, str]]:
    """Texts, and rewrites that share from less than 0.6 to over 0.9 with them; a
    line that all have; a chain whose ends alone are not similar; short texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    out, line = [], " ".join(word() for _ in range(12))
    for _ in range(20):
        base = [word() for _ in range(rng.randrange(40, 160))]
        out.append(f"{' '.join(base)} {line}")
        for share in (0.97, 0.92, 0.9, 0.88, 0.86, 0.82, 0.75):
            cut = int(len(base) * share)
            out.append(f"{' '.join(base[:cut] + [word() for _ in range(len(base) - cut)])} {line}")
    chain = [word() for _ in range(130)]
    out += [" ".join(chain[i : i + 100]) for i in (0, 10, 20, 30)]
    out += ["a b c d e f g h i", "a b c d e f g h", "a b c d", "a b c", "", " "]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(d, out[i]) for d, i in enumerate(order)]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_are_exact(spark, chunk):
    rows = graded()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()}
    assert got == brute.similar(dict(rows))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_a_large_group(spark, chunk):
    """More near copies than a block compares pair by pair; two groups that only
    some members join; a group whose fingerprints are near but whose sets are not
    similar enough."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    base, out = [word() for _ in range(300)], []
    for share in (0.97, 0.88, 0.75):
        for _ in range(40):
            cut = int(len(base) * share)
            out.append(" ".join(base[:cut] + [word() for _ in range(len(base) - cut)]))
    rng.shuffle(out)
    rows = list(enumerate(out))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=chunk, broadcast_ids=4096 if chunk > 3 else 0).collect()}
    assert got == brute.similar(dict(rows))


def test_rounds_get_no_more_links_than_members(spark, monkeypatch):
    """Near copies meet in most blocks, each of which links them anew; rounds of
    joins must not get those links."""
    rng, given, rounds = random.Random(9), [], common.connected_components
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    base = [word() for _ in range(300)]
    texts = [" ".join(base[:k] + [word() for _ in range(4)] + base[k + 4 :]) for k in range(0, 240, 4)]

    def counted(edges, *more):
        given.append(edges.count())
        return rounds(edges, *more)

    monkeypatch.setattr(common, "connected_components", counted)
    monkeypatch.setattr(simhash, "connected_components", counted)
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert all(n <= len(texts) for n in given), given


@pytest.mark.parametrize("unit", [1 << 20, 50])
def test_forest_components(spark, unit):
    rng = random.Random(3)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(7000, 7000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = {r["node"]: r["root"] for r in common.forest_components(frame, unit).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {n: got.get(n, n) for n in want} == want
    assert common.forest_components(frame.limit(0), unit).count() == 0


def test_recall_and_precision(spark):
    """Pairs of just over the similarity asked for are found; none is made up."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows, close = [], 0
    for k in range(400):
        base = [word() for _ in range(rng.randrange(100, 400))]
        shared = rng.uniform(0.86, 0.94)
        cut = int(len(base) * shared)
        pair = " ".join(base), " ".join(base[:cut] + [word() for _ in range(len(base) - cut)])
        x, y = map(brute.shingles, pair)
        close += 0.8 <= len(x & y) / len(x | y) < 0.85
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
    assert close > 100
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {}
    for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        x, y = brute.shingles(x), brute.shingles(y)
        want[b] = a if len(x & y) / len(x | y) >= 0.8 else b
    assert all(got[b] in (b, a) for b, a in want.items())
    wrong = [b for b, a in want.items() if a == b and got[b] != b]
    missed = [b for b, a in want.items() if a != b and got[b] != a]
    assert not wrong and len(missed) <= 0.01 * sum(a != b for b, a in want.items())


def test_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, TINY).collect()}
    assert left == set(brute.similar({r["doc_id"]: r["text"] for r in docs.collect()}).values())
