"""The pipeline against a brute-force version of each stage."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from catalyte.llm import mixing, queries, toxicity

from . import brute
from .test_operators import check_packing, docs, none, similar_classes  # noqa: F401
from ..conftest import TINY


def test_contract():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_against_brute_force(spark, tmp_path):
    now = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = now.columns
    labels = spark.read.parquet(f"{TINY}/labels.parquet").where(~queries.held_out())
    scorer = toxicity.Scorer(toxicity.fit(now, labels))
    rows = {r["doc_id"]: r for r in now.collect()}
    want = {d: r["text"] for d, r in rows.items() if scorer([r["text"] or ""])[0] < 0.7}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, TINY).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        if name == "simhash_near_dedup":
            firsts = set(similar_classes(want).values())
            want = {d: t for d, t in want.items() if d in firsts}
        elif name == "suffix_array_dedup":
            want = brute_rest(want)
        elif name == "mixing":
            topics = {r["doc_id"]: r["topic"] for r in before.select("doc_id", mixing.topic_of(F.col("text")).alias("topic")).collect()}
            cells: dict = {}
            cell = {d: (rows[d]["source"], rows[d]["lang"], topics[d]) for d in want}
            for d, t in want.items():
                cells[cell[d]] = cells.get(cell[d], 0) + len(brute.words(t))
            targets = []
            for axis in range(3):
                sums: dict = {}
                for c, v in cells.items():
                    sums[c[axis]] = sums.get(c[axis], 0.0) + v
                targets.append(mixing.tempered(sums))
            factor = brute.rake(cells, targets)
            most = max(factor.values())
            want = {d: t for d, t in want.items() if brute.unit(d) < factor[cell[d]] / most}
        if name == "packing":
            check_packing(now.collect(), sorted(want.items()), 2048)
        else:
            assert now.columns == columns
            assert {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()} == want, name
        before = now


def brute_rest(texts):
    from .test_operators import brute_without

    return brute_without(sorted(texts.items()))


def test_run(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, TINY).columns)


def test_stages_take_odd_tables(spark, docs, none):  # noqa: F811
    clashing = docs.withColumn("probability_of_rain", F.lit(1))
    for df in (clashing, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, TINY)
            assert out.count() >= 0 and (name == "packing" or out.columns == df.columns)
