"""SimHash near-duplicate detection (pigeonhole blocks).

``near_duplicates`` links fingerprints of 64 bits that differ in few bits. They
are cut into pieces, ``distance`` + 2 of them or more: fingerprints that differ
in at most ``distance`` bits agree on the other pieces, so they share a block of
that many pieces; rows are joined on blocks and the Hamming distance of what
meets there is verified. With six pieces and four bits there are fifteen blocks
of two pieces; more distinct fingerprints take more pieces and wider blocks.

``similar_documents`` links texts by the similarity of their shingle sets, which
fingerprints estimate: long ones, cut into blocks of sampled bits, whose number
follows from the share of similar pairs that may be missed. What meets in a block
and is near by Hamming distance is verified on the whole sets.

Scale: equal fingerprints (or sets) are collapsed first, so a large group of
copies costs one row. A block's members are compared in numpy without emitting
the pairs: a spanning forest of the links leaves a large block. A block of more
than ``chunk`` members is dealt out as pairs of chunks, each its own unit of work.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, durable, forest_components, free_name, mix, slices, texts_of, tidy, window_hashes, word_hashes

#: Members that a block of fingerprints of random bits may have on average.
MEMBERS = 1024


def pieces(rows: int, distance: int = 4) -> list[tuple[int, int]]:
    """Lowest bit and width of each piece, so many that blocks of all pieces but
    ``distance`` hold ``MEMBERS`` of ``rows`` random fingerprints at most."""
    many = distance + 2
    while many < 16 and rows > MEMBERS << (64 * (many - distance) // many):
        many += 1
    edges = [64 * k // many for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text; zero for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count
    as empty."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that span the graph of links among ``fps``: each member is
    taken from the pool of unseen ones as soon as any seen one reaches it."""
    found: list[tuple[int, int]] = []
    pool = np.arange(len(fps))
    while len(pool) > 1:
        todo, pool = [pool[0]], pool[1:]
        while todo and len(pool):
            at = todo.pop()
            near = np.bitwise_count(fps[pool] ^ fps[at]) <= distance
            if near.any():
                hits = pool[near]
                found.extend((at, h) for h in hits)
                todo.extend(hits)
                pool = pool[~near]
    return found


def _links(distance: int):
    def work(batches):
        """Rows come sorted by (block, lo, hi); a group may span batches."""
        rest: tuple[np.ndarray, np.ndarray] | None = None

        def emit(keys, fps):
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]])
            a, b = [], []
            pair = begin[end - begin == 2]
            near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= distance]
            a.append(fps[near])
            b.append(fps[near + 1])
            big = end - begin > 2
            for i, j in zip(begin[big], end[big], strict=True):
                if links := forest(fps[i:j], distance):
                    x = np.array(links)
                    a.append(fps[i:j][x[:, 0]])
                    b.append(fps[i:j][x[:, 1]])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "lo", "hi")], axis=1)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if rest is not None:
                keys, fps = np.concatenate([rest[0], keys]), np.concatenate([rest[1], fps])
            last = len(fps) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
            rest = keys[last:], fps[last:]
            if last:
                yield emit(keys[:last], fps[:last])
        if rest is not None:
            yield emit(*rest)

    return work


def fingerprint_links(fps: DataFrame, distance: int = 4, chunk: int = 4096) -> DataFrame:
    """(a, b): links that span every component of the distinct fingerprints in
    column fp, two of which are linked at ``distance`` or fewer differing bits.
    ``fps`` is read three times: it should be a written or checkpointed table."""
    cut = pieces(fps.count(), distance)

    def block(k: int, some: tuple[int, ...]):
        key = F.lit(k).cast("long")
        for low, width in (cut[i] for i in some):
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return key

    blocks = [block(k, some) for k, some in enumerate(itertools.combinations(range(len(cut)), len(cut) - distance))]
    keyed = fps.select("fp", F.explode(F.array(*blocks)).alias("block"))
    hot = keyed.groupBy("block").count().where(F.col("count") > chunk)
    hot = hot.select("block", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), n.cast("long")).cast("int")
    others = F.sequence(F.lit(0), n - 1)
    dealt = (
        keyed.join(hot, "block", "left")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(others))
        .select("block", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    )
    sorted_rows = dealt.repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi")
    return sorted_rows.mapInArrow(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, chunk: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links of at most ``distance`` differing
    bits, its own included).

    Null and empty texts have fingerprint zero and are linked like any other;
    rows with a null doc_id are kept and take part; repeated rows stay. Columns
    other than doc_id and text are ignored, whatever their names.
    """
    fps = durable(fingerprints(docs, shingle))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(own.select("fp"), distance, chunk).distinct())
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --------------------------------------------------------------------------
# by similarity: long fingerprints find what meets, whole shingle sets decide

#: Bits of a long fingerprint; how many of them travel with a block's members.
LONG, CARRIED = 512, 128
#: Share of the pairs of just the similarity asked for that may share no block.
MISSED = 0.001
#: Members up to which all near pairs of a block are emitted.
FEW = 8
#: Bits of a parity sketch.
PARITY = 2048


def agreement(similarity: float) -> float:
    """Chance that a bit of two fingerprints agrees, of sets of equal size and
    this Jaccard similarity: their vectors have a cosine of 2s / (1 + s)."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def sampled_blocks(rows: int, similarity: float) -> np.ndarray:
    """Bit positions of each block, one block a row. The width follows from the
    number of rows, and the number of blocks from the width."""
    width = max(16, int(np.ceil(np.log2(max(1, rows) / MEMBERS))))
    many = int(np.ceil(np.log(MISSED) / np.log1p(-(agreement(similarity) ** width))))
    return np.random.default_rng(20).permuted(np.tile(np.arange(LONG), (many, 1)), axis=1)[:, :width]


def allowed_bits(similarity: float, bits: int = CARRIED) -> int:
    """Differing bits of ``bits`` that sets of this similarity have at most: the
    mean and three and a half standard deviations."""
    p = 1 - agreement(similarity)
    return int(np.floor(bits * p + 3.5 * np.sqrt(bits * p * (1 - p))))


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is
    one shingle."""
    words = word_hashes(text.lower())
    return np.unique(window_hashes(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """The majority of each of ``LONG`` bits over a shingle set; all zero without
    shingles."""
    ones = np.zeros(LONG, np.int64)
    for at in range(0, len(hashes), 255):  # so many ones at most in a byte
        part = np.stack([mix(hashes[at : at + 255] + np.uint64(k)) for k in range(LONG // 64)], axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` buckets, whether it has an odd number of hashes. Two
    sets differ in at least as many elements as their sketches do in bits."""
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(batches):
    for batch in batches:
        sets = [np.asarray(x.values, np.int64).view(np.uint64) for x in batch.column("shingles")]
        wide = [parity(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.list_(pa.int64()))], names=["node", "n", "wide"])


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _signatures(shingle: int):
    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingle_set(t, shingle) for t in texts_of(batch.column("text"))]
                nodes = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
                prints = [long_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(nodes), pa.array(prints, pa.binary())], names=["doc_id", "key", "node", "print"])

    return work


def _sets(shingle: int):
    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingle_set(t, shingle) for t in texts_of(batch.column("text"))]
                nodes = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return work


BLOCKS = "block long, node long, x long, y long"


def _blocks(positions: np.ndarray):
    """(block, node, x, y) for each row and block; x and y are the bits that
    travel along."""
    many, width = positions.shape
    powers = 1 << np.arange(width, dtype=np.int64)
    first = np.arange(many, dtype=np.int64) << width

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(-1, LONG // 8)
                bits = np.unpackbits(raw, axis=1)
                keys = np.empty((len(raw), many), np.int64)
                for k in range(many):
                    keys[:, k] = bits[:, positions[k]] @ powers + first[k]
                carried = np.ascontiguousarray(raw[:, : CARRIED // 8]).view(np.int64)
                columns = [np.repeat(c, many) for c in (part.column("node").to_numpy(), carried[:, 0], carried[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *map(pa.array, columns)], names=["block", "node", "x", "y"])

    return work


def _near_groups(batches, columns):
    """Batches of whole groups of equal ``block``, in which rows come sorted."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in columns]
        if (now[0][1:] < now[0][:-1]).any() or (rest is not None and now[0][0] < rest[0][-1]):
            raise ValueError("rows of a block are not together")
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[last:] for x in now]
        if last:
            yield [x[:last] for x in now]
    if rest is not None:
        yield rest


def _apart(bits: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count(bits[a] ^ bits[b]).sum(axis=-1, dtype=np.int64)


def _pairs_of(a: list, b: list, d: list) -> pa.RecordBatch:
    """Distinct pairs (a, b), the smaller first, and their distance."""
    a, b, d = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, d))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), d], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([*(pa.array(both[:, k]) for k in range(3)), pa.nulls(len(both), pa.int64())], names=["a", "b", "d", "dense"])


def _meet(most: int, close: int):
    """(a, b, d): pairs of each block at ``most`` differing bits, all of them among
    few members, else a spanning forest of those at ``close`` bits, and members
    with themselves; (dense): blocks in which pairs were left out."""

    def work(batches):
        for block, node, x, y in _near_groups(batches, ("block", "node", "x", "y")):
            bits = np.stack([x, y], axis=1).view(np.uint64)
            a, b, d, dense = [], [], [], []
            cut = np.flatnonzero(np.diff(block)) + 1
            begin, end = np.append(0, cut), np.append(cut, len(block))
            size = np.repeat(end - begin, end - begin)
            for gap in range(1, FEW):  # few members: each with the one ``gap`` rows on
                i = np.flatnonzero((block[:-gap] == block[gap:]) & (size[:-gap] <= FEW))
                if not len(i):
                    break
                off = _apart(bits, i, i + gap)
                on = (off <= most) & (node[i] != node[i + gap])
                a.append(node[i[on]])
                b.append(node[i[on] + gap])
                d.append(off[on])
            for i, j in zip(begin[end - begin > FEW].tolist(), end[end - begin > FEW].tolist(), strict=True):
                pool, left_out = np.arange(i, j), np.zeros(j - i, bool)
                while len(pool) > 1:
                    todo, pool = [pool[0]], pool[1:]
                    while todo and len(pool):
                        at = todo.pop()
                        off = _apart(bits, pool, at)
                        hit, near = off <= close, off <= most
                        left_out[pool[near] - i] = True
                        left_out[at - i] |= near.any()
                        if hit.any():
                            a.append(np.full(int(hit.sum()), node[at]))
                            b.append(node[pool[hit]])
                            d.append(off[hit])
                            todo.extend(pool[hit].tolist())
                            pool = pool[~hit]
                if left_out.any():
                    dense.append(block[i])
                    some = node[i:j][left_out]  # with itself: it has met others
                    a.append(some)
                    b.append(some)
                    d.append(np.zeros(len(some), np.int64))
            yield _pairs_of(a, b, d)
            if dense:
                none = pa.nulls(len(dense), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.array(dense, np.int64))], names=["a", "b", "d", "dense"])

    return work


def _meet_apart(most: int, similarity: float):
    """(a, b, d): every pair of a block at ``most`` differing bits whose members
    have different roots, but for those whose parity sketches show that their
    sets are less similar."""
    share = (1 - similarity) / (1 + similarity)

    def work(batches):
        columns = ("block", "node", "x", "y", "root", "n")
        for block, node, x, y, root, n, *wide in _near_groups(batches, (*columns, *(f"w{k}" for k in range(PARITY // 64)))):
            bits, wide = np.stack([x, y], axis=1).view(np.uint64), np.stack(wide, axis=1).view(np.uint64)
            cut = np.flatnonzero(np.diff(block)) + 1
            a, b, d, size = [], [], [], 0
            for i, j in zip(np.append(0, cut).tolist(), np.append(cut, len(block)).tolist(), strict=True):
                if (root[i:j] == root[i]).all():
                    continue
                for at in range(i, j - 1):
                    rest = np.arange(at + 1, j)
                    rest = rest[root[rest] != root[at]]
                    off = _apart(bits, rest, at)
                    rest, off = rest[off <= most], off[off <= most]
                    on = _apart(wide, rest, at) <= share * (n[rest] + n[at]) + 1e-9
                    rest, off = rest[on], off[on]
                    if len(rest):
                        a.append(np.full(len(rest), node[at]))
                        b.append(node[rest])
                        d.append(off)
                        size += len(rest)
                    if size > 1 << 20:
                        yield _pairs_of(a, b, d)
                        a, b, d, size = [], [], [], 0
            yield _pairs_of(a, b, d)

    return work


def _hot(own: DataFrame, positions: np.ndarray, chunk: int) -> DataFrame:
    """(block, parts): blocks of many members. Every 16th row shows which these
    are; that only decides how the work is dealt."""
    share = max(1, min(16, chunk // 256))
    some = own.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(tidy(_blocks(positions)), BLOCKS)
    return durable(some.groupBy("block").count().where(F.col("count") * share > chunk).select("block", F.ceil(F.col("count") * share / chunk).cast("int").alias("parts")))


def _dealt(own: DataFrame, positions: np.ndarray, hot: DataFrame) -> DataFrame:
    """(block, node, x, y): blocks of many members as pairs of chunks, each with
    a block number of its own."""
    keyed, many = own.mapInArrow(tidy(_blocks(positions)), BLOCKS), hot.count()
    if not many:
        return keyed
    parts = F.coalesce("parts", F.lit(1))
    number = F.when(F.col("parts").isNull(), F.col("block")).otherwise(F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other")))
    joined = keyed.join(F.broadcast(hot) if many <= 100_000 else hot, "block", "left")
    return joined.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), parts.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(number.alias("block"), "node", "x", "y")


def _text_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk: int = 4096, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: components of documents
    whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Documents meet by SimHash blocks; each link is
    verified on the whole sets, so none is wrong; of pairs of just
    ``similarity`` about one in 200 shares no block, of closer ones hardly any.

    Equal sets are collapsed first. Pairs are verified in rounds, so that a large
    group does not cost all of its pairs: each document with the closest that it
    met, then what else was found between components; last, in large blocks, all
    that is near and not in one component yet. Null texts count as empty, and
    texts without words are alike; repeated rows stay; an empty table gives no
    rows. Up to ``broadcast_ids`` ids of documents that met others are broadcast
    (a counted size); more are joined by shuffle.
    """
    return _classes(docs, shingle, similarity, chunk, broadcast_ids).select("doc_id", "component_id")


def _classes(docs: DataFrame, shingle: int, similarity: float, chunk: int, broadcast_ids: int) -> DataFrame:
    """``similar_documents`` with a hash of the text and the component's own
    number: (doc_id, key, root, component_id)."""
    rows = docs.select(F.col("doc_id").cast("long"), _text_key(docs).alias("key"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    prints = durable(rows.mapInArrow(tidy(_signatures(shingle)), "doc_id long, key long, node long, print binary"))
    own = durable(prints.groupBy("node", "print").agg(F.min("doc_id").alias("doc_id")))
    positions, most, close = sampled_blocks(own.count(), similarity), allowed_bits(similarity), int(CARRIED * (1 - agreement(similarity)))
    hot, pair = _hot(own.select("node", "print"), positions, chunk), "a long, b long, d long, dense long"
    dealt = _dealt(own.select("node", "print"), positions, hot)
    found = durable(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_meet(most, close)), pair).distinct())
    pairs = found.where("a <> b").select("a", "b", "d")
    met = durable(own.join(found.where("dense IS NULL").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "doc_id"))
    wanted = met.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if met.count() <= broadcast_ids else wanted
    sets = durable(rows.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(_sets(shingle)), "node long, shingles array<long>").dropDuplicates(["node"]))

    def verified(some: DataFrame) -> DataFrame:
        for x in "ab":
            some = some.join(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")), x)
        common, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
        return durable(some.where(common >= F.lit(similarity) * (total - common)).select("a", "b"))

    def apart(some: DataFrame, roots: DataFrame) -> DataFrame:
        for x in "ab":
            some = some.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
        return some.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "d")


    def closest(some: DataFrame) -> DataFrame:
        ways = some.select("a", "b", "d").union(some.select("b", "a", "d")).groupBy("a").agg(F.min(F.struct("d", "b")).alias("to"))
        return ways.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b")).distinct()

    def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
        # Of a group's many links those to its root are enough.
        return durable(forest_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))

    roots = durable(forest_components(verified(closest(pairs))))
    roots = joined(roots, verified(apart(pairs, roots)))
    dense = durable(found.where("dense IS NOT NULL").select(F.col("dense").alias("block")).distinct())
    if dense.head(1):
        # Only members that met others; blocks of one component cost no comparison.
        members = own.select("node", "print").join(met.select("node"), "node", "left_semi")
        rooted = met.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        facts = durable(sets.mapInArrow(tidy(_sketches), "node long, n long, wide array<long>").join(rooted, "node"))
        wide = [F.col("wide")[k].alias(f"w{k}") for k in range(PARITY // 64)]
        spread = _dealt(members, positions, hot).join(dense, "block", "left_semi").join(facts, "node").select("block", "node", "x", "y", "root", "n", *wide)
        # Written before it is dealt: planned as one with the joins, rows came unsorted.
        last = durable(spread).repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_meet_apart(most, similarity)), pair)
        roots = joined(roots, verified(last.select("a", "b").distinct()))
    classes = own.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "key", "node").join(classes.select("node", "root").join(least, "root"), "node").select("doc_id", "key", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk: int = 4096, broadcast_ids: int = 1_000_000) -> DataFrame:
    """``docs`` with the document of the lowest doc_id of each component alone,
    all columns as they are. Rows without a doc_id are returned unchanged. Of
    rows that share a doc_id and a component one stays: the text of the lowest
    hash, and of equal texts the row of the lowest hash over all columns."""
    names = docs.columns
    number = F.row_number().over(Window.partitionBy("doc_id", "root").orderBy("key"))
    found = _classes(docs, shingle, similarity, chunk, broadcast_ids).groupBy("doc_id", "key", "root", "component_id").count()
    found = durable(found.withColumn("stays", (number == 1) & (F.col("doc_id") == F.col("component_id"))))
    doc, key = free_name("doc", names), free_name("key", names)
    side = lambda rows: rows.select(F.col("doc_id").alias(doc), F.col("key").alias(key))
    gone, twice = side(found.where("NOT stays")), side(found.where("stays AND count > 1"))
    gone = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    same = (docs["doc_id"].cast("long") == F.col(doc)) & (_text_key(docs) == F.col(key))
    left = docs.join(gone, same, "left_anti")
    if not twice.head(1):
        return left
    row = free_name("row", names)
    whole = F.struct(*(docs[f"`{c}`"] for c in names))
    ones = docs.join(twice, same).groupBy(doc, key).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row))
    return left.join(twice, same, "left_anti").unionByName(ones.select(f"{row}.*"))
