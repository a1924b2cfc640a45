"""Exact top-k search by inner product over integer vectors.

Vectors are visited by descending length. Both sides are rotated by the right
singular vectors of a bounded sample, so that the first coordinates carry most
of a product; a partial sum over them plus the Cauchy-Schwarz bound of the rest
(product of the residual lengths) discards a candidate, and once the product of
the whole lengths is under a query's k-th best score, all later candidates are.
The rotation only prunes: every surviving score is recomputed exactly.

Candidates are dealt into ranges of length, a range with many rows into several
blocks; queries are dealt into chunks by how far they reach: the ranges whose
longest vector can still beat the threshold that the longest vectors of all give
them. A query is sent to blocks it reaches alone, a candidate to chunks that reach
it. Each (block, chunk) is one unit of work of bounded size, so a common vector or
length gathers nowhere, and what leaves a unit is k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

EXACT = 2.0**52


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, norm) with v = floor(scale * x), x as double. Vectors that
    are null, hold a null or a component that is not finite are left out, as
    are rows without an id; a row that is there twice stays twice. A component
    that does not fit a long raises ValueError: no integer stands for it."""

    def work(batches):
        for batch in batches:
            lists = batch.column("embedding")
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            keep, out, norms = [], [], []
            for at, x in enumerate(lists):
                if not x.is_valid or x.values.null_count:
                    continue
                x = x.values.to_numpy().astype(np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        v = np.floor(scale * x)
                    if len(v) and np.abs(v).max() >= 2.0**63:
                        raise ValueError(f"vector {ids[at]}: a component times {scale} does not fit a long")
                    keep.append(at)
                    out.append(v.astype(np.int64))
                    norms.append(float(np.sqrt((v * v).sum())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep].astype(np.int64)), pa.array(out, pa.list_(pa.int64())), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm"]
            )

    clean = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL")
    return clean.mapInArrow(work, "vec_id long, v array<long>, norm double")


def matrix(column, width: int) -> np.ndarray:
    """A list column as a matrix of whole numbers of ``width`` columns; shorter
    vectors count as ending in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def search_block(ids, vectors, query_ids, queries, floors, rotation, k: int, step: int = 2048):
    """Rows (query index, candidate index, score) of each query's k best among
    ``vectors``, given a lower bound ``floors`` of its k-th best score. Vectors
    and queries are matrices of whole numbers."""
    whole_vectors, whole_queries = vectors, queries
    vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.lexsort((ids, -norms))
    ids, vectors, norms, whole_vectors = ids[order], vectors[order], norms[order], whole_vectors[order]
    head = min(vectors.shape[1], max(1, vectors.shape[1] // 4))
    rc, rq = vectors @ rotation, queries @ rotation
    rest = lambda x: np.sqrt((x[:, head:] ** 2).sum(axis=1))
    res_c, res_q, q_norms = rest(rc), rest(rq), np.sqrt((queries * queries).sum(axis=1))
    exact = not len(vectors) or not len(queries) or float(norms.max() * q_norms.max()) < EXACT
    floors = floors.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        slack = 1e-6 + 1e-9 * q_norms * norms[at]
        active = np.flatnonzero(q_norms * norms[at] + slack >= floors)
        if not len(active):
            break
        for few in np.array_split(active, -(-len(active) // 512)):
            bound = rq[few, :head] @ rc[part, :head].T + np.outer(res_q[few], res_c[part]) + slack[few, None]
            keep = (bound >= floors[few, None]) & (ids[part][None, :] != query_ids[few, None])
            for row, q in enumerate(few):
                hit = np.flatnonzero(keep[row]) + at
                if not len(hit):
                    continue
                if exact:
                    score = (vectors[hit] @ queries[q]).astype(np.int64)
                else:
                    whole = (whole_vectors[hit].astype(object) * whole_queries[q].astype(object)).sum(axis=1) if len(queries[q]) else [0] * len(hit)
                    if any(not -(1 << 63) <= int(x) < 1 << 63 for x in whole):
                        raise ValueError(f"query {query_ids[q]}: an inner product does not fit a long")
                    score = np.array([int(x) for x in whole], np.int64)
                scores, members = np.concatenate([best[q][0], score]), np.concatenate([best[q][1], hit])
                first = np.lexsort((ids[members], -scores))[:k]
                best[q] = scores[first], members[first]
                if len(first) == k:
                    floors[q] = max(floors[q], float(scores[first[-1]]))
    return ids, best


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, seeds: int = 2048, block: int = 65_536, chunk: int = 8_192, ranges: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank,
    vec_id, score; ties go to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but those of the query's id. A candidate that is there twice counts
    twice; rows that share a query's id are one query, which gets the best of
    theirs. Vectors without a valid form take no part (see ``integer_vectors``);
    those of another length count as ending in zeros; an inner product that does
    not fit a long raises ValueError; an empty table gives no rows; other columns
    are ignored. ``seeds`` bounds the longest vectors the driver uses for the
    rotation and the first thresholds, ``ranges`` the ranges of length.
    """
    spark = rows.sparkSession
    base = durable(integer_vectors(rows, scale))
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], max(1, facts["width"] or 0)
    top = base.orderBy(F.desc("norm"), "vec_id").limit(seeds).select("vec_id", "v").collect()
    seed_ids = np.array([r["vec_id"] for r in top], np.int64)
    seed = np.zeros((len(top), width))
    for at, r in enumerate(top):
        seed[at, : len(r["v"])] = r["v"]
    rotation = np.linalg.svd(seed, full_matrices=True)[2].T if 0 < len(top) else np.eye(width)
    # Ranges of length, the longest first, from quantiles; they only deal the work.
    many = min(ranges, max(1, -(-n // block), min(64, -(-n // 2048))))
    steps = [k / many for k in range(1, many)]
    edges = np.unique(base.agg(F.percentile_approx("norm", steps).alias("q")).first()["q"] if n and steps else []).astype(np.float64)
    ranged = base.mapInArrow(_ranged(edges), "vec_id long, v array<long>, norm double, range int")
    found = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    longest = np.array([found[r]["longest"] if r in found else 0.0 for r in range(len(edges) + 1)])
    longest = np.maximum.accumulate(longest[::-1])[::-1]
    blocks = np.array([-(-found[r]["n"] // block) if r in found else 0 for r in range(len(edges) + 1)])
    shared = spark.sparkContext.broadcast((seed_ids, seed, rotation, longest))

    def floors(batches):
        ids, vectors, _, longest = shared.value
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("v"), width).astype(np.float64)
                own = batch.column("vec_id").to_numpy()
                low = np.full(len(own), -np.inf)
                for at in range(0, len(own), 256):
                    scores = q[at : at + 256] @ vectors.T
                    scores[ids[None, :] == own[at : at + 256, None]] = -np.inf
                    if scores.shape[1] >= k:
                        low[at : at + 256] = np.partition(scores, -k, axis=1)[:, -k]
                # a float sum may be off by rounding where products are huge
                low = low - np.where(np.isfinite(low), 1e-9 * np.abs(low), 0)
                length = np.sqrt((q * q).sum(axis=1))
                reach = (length[:, None] * longest[None, :] * (1 + 1e-9) + 1e-6 >= low[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(low), pa.array(reach, pa.int32())], names=["vec_id", "v", "floor", "reach"])

    def cell(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not candidates.num_rows or not queries.num_rows:
            return none
        q_ids = queries["vec_id"].to_numpy()
        ids, best = search_block(candidates["vec_id"].to_numpy(), matrix(candidates["v"], width), q_ids, matrix(queries["v"], width), queries["floor"].to_numpy().copy(), shared.value[2], k)
        counts = [len(b[0]) for b in best]
        return pa.table({"query_id": np.repeat(q_ids, counts), "vec_id": ids[np.concatenate([b[1] for b in best])], "score": np.concatenate([b[0] for b in best])})

    queries = durable(base.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(floors, "vec_id long, v array<long>, floor double, reach int"))
    # Chunks in descending order of reach, each with the reach of its first query.
    counts = sorted(((r["reach"], r["n"]) for r in queries.groupBy("reach").agg(F.count("*").alias("n")).collect()), reverse=True)
    span, reaches, at = {}, [], 0
    for reach, some in counts:
        span[reach] = at // chunk, (at + some - 1) // chunk
        reaches += [reach] * (span[reach][1] + 1 - len(reaches))
        at += some
    before = np.concatenate([[0], np.cumsum(blocks)])
    met = [sum(reach > r for reach in reaches) for r in range(len(blocks))]  # chunks that reach a range
    pick = lambda values, index: F.element_at(F.array(*(F.lit(int(v)) for v in values)), index + 1)
    spot = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), m.cast("long")).cast("int")
    dealt_c = ranged.select("vec_id", "v", pick(before, F.col("range")).alias("first"), pick(blocks, F.col("range")).alias("many"), pick(met, F.col("range")).alias("met")).where("met > 0")
    candidates = dealt_c.select("vec_id", "v", (F.col("first") + spot(F.col("many"), 2)).alias("block"), F.explode(F.sequence(F.lit(0), F.col("met") - 1)).alias("chunk"))
    low, high = ([span.get(r, (0, 0))[side] for r in range(len(blocks) + 1)] for side in (0, 1))
    dealt_q = queries.where("reach > 0").withColumns({"low": pick(low, F.col("reach")), "high": pick(high, F.col("reach")), "reached": pick(before, F.col("reach"))})
    asked = dealt_q.select("vec_id", "v", "floor", (F.col("low") + spot(F.col("high") - F.col("low") + 1, 1)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("reached") - 1)).alias("block"))
    best = candidates.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranged(edges: np.ndarray):
    def work(batches):
        for batch in batches:
            spot = len(edges) - np.searchsorted(edges, batch.column("norm").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "norm")), pa.array(spot, pa.int32())], names=["vec_id", "v", "norm", "range"])

    return work
