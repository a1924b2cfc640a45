"""Exact-substring dedup with a sparse suffix array.

Suffixes start at words. Kept are those at minimiser positions: in every run of
``min_words - seed_words + 1`` positions the one whose leading ``seed_words``
words hash lowest, chosen by content alone, so equal passages keep equal
positions, and a passage of ``min_words`` words holds at least one.

Suffixes whose heads (leading ``seed_words`` words) two texts share go, with the
words around them, to the task of their head. There they are sorted in suffix
order and neighbours are compared word by word, which gives the longest common
extension to the right; sorting the reversed words before them and comparing
neighbours again gives the extension to the left. A stretch of ``min_words``
words around a kept position is repeated if suffixes of two documents agree on
its part to the right and on its part to the left. Words are compared as they
are; hashes only choose positions and say where suffixes meet.

Scale: the first pass emits about two positions in ``min_words - seed_words``
words; only positions with a shared head carry their words. A head of more than
``hot`` positions (a passage that a third of all documents share) is no group:
its stretches are counted by a 128-bit hash of their words, an aggregation with
map-side combining. Copies of a whole text are collapsed to one member before
and reported as repeats of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, range_hashes, slices, texts_of, tidy, window_hashes, word_bounds

SPAN = "doc_id long, start long, n_words long, first_doc_id long, is_first boolean"
#: Rows that a task compares at a time.
ROWS = 16_384


def minimisers(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions that hold the lowest hash of some run of ``run`` positions."""
    if len(hashes) <= run:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    out = [np.unique(windows[at : at + (1 << 14)].argmin(axis=1) + np.arange(at, min(at + (1 << 14), len(windows)))) for at in range(0, len(windows), 1 << 14)]
    return np.unique(np.concatenate(out))


def text_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and the words' byte offsets."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_bounds(raw)
    return (range_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)), starts, ends


def kept_suffixes(docs: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """(doc_id, k1, k2, n, heads) of every row with a doc_id: two independent
    hashes that stand for its text, its words, and the heads of its kept
    suffixes."""
    run = min_words - seed_words + 1

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, heads = [], []
                for text in texts_of(batch.column("text")):
                    words = text_words(text)[0]
                    counts.append(len(words))
                    if len(words) >= min_words:
                        hashes = window_hashes(words, seed_words)
                        heads.append(hashes[minimisers(hashes, run)].view(np.int64))
                    else:
                        heads.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(counts, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "n", "heads"]
                )

    return _keyed(docs).mapInArrow(tidy(work), "doc_id long, k1 long, k2 long, n long, heads array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    return rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))


def _contexts(min_words: int, seed_words: int):
    """Around each position with a shared head: the words before and from it, one
    space between, a missing word empty. Around one with a hot head: a 128-bit
    hash of each stretch of ``min_words`` words."""
    run, before = min_words - seed_words + 1, min_words - seed_words

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                out: list[tuple] = []
                size = 0
                for doc, k1, text, met in zip(batch.column("doc_id").to_pylist(), batch.column("k1").to_pylist(), batch.column("text"), batch.column("met"), strict=True):
                    raw = text.as_py().encode()
                    words, starts, ends = text_words(raw.decode())
                    if len(words) < min_words:
                        continue
                    hashes = window_hashes(words, seed_words)
                    at = minimisers(hashes, run)
                    heads = met.values.field("head").to_numpy()
                    order = np.argsort(heads)
                    heads, hot = heads[order], met.values.field("hot").to_numpy(zero_copy_only=False)[order]
                    own = hashes[at].view(np.int64)
                    spot = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
                    found = heads[spot] == own
                    at, own, hot = at[found], own[found], hot[spot[found]]
                    parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    for p, head in zip(at[~hot].tolist(), own[~hot].tolist(), strict=True):
                        left, right = parts[max(0, p - before) : p], parts[p : p + min_words]
                        slots = [b""] * (before - len(left)) + left + right + [b""] * (min_words - len(right))
                        out.append((doc, k1, p, head, b" ".join(slots).decode(), None))
                    if hot.any():
                        first = np.unique((at[hot][:, None] - np.arange(run)[None, :]).reshape(-1))
                        for s in first[(first >= 0) & (first <= len(words) - min_words)].tolist():
                            out.append((doc, k1, s, None, None, xxhash.xxh3_128_digest(b" ".join(parts[s : s + min_words]))))
                    size += len(raw)
                    if len(out) > 8 * ROWS:
                        yield _table(out)
                        out = []
                if out:
                    yield _table(out)

    def _table(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "k1", "at", "head", "words", "h"])

    return work


def _order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of small whole numbers, column by column."""
    flat = np.ascontiguousarray((rows + 1).astype(">u4"))
    return np.argsort(flat.view(f"V{4 * rows.shape[1]}").reshape(-1), kind="stable")


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading columns each row, in ``order``, has in common with the one
    before; the first one, none."""
    off = rows[order[1:]] != rows[order[:-1]]
    return np.concatenate([[-1], np.where(off.any(axis=1), off.argmax(axis=1), rows.shape[1])])


def _runs(common: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each row the number of its run of neighbours with ``least`` columns in
    common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least)
    return out


def repeated_around(docs: np.ndarray, slots: np.ndarray, missing: int, min_words: int, seed_words: int) -> np.ndarray:
    """For suffixes (documents, and the word numbers in ``slots`` before and from
    their positions): a row for each, with a column for each stretch of
    ``min_words`` words around the position, leftmost first: the lowest document
    that holds the stretch, if two do, or else -1."""
    before = min_words - seed_words
    right, left = slots[:, before:], slots[:, :before][:, ::-1]
    n_right, n_left = (right != missing).sum(axis=1), (left != missing).sum(axis=1)
    by_right = _order(right)
    common_right = _common(right, by_right)
    left = np.concatenate([_runs(common_right, by_right, seed_words)[:, None], left], axis=1)
    by_left = _order(left)
    common_left = _common(left, by_left)
    out = np.full((len(docs), before + 1), -1, np.int64)
    for back in range(before + 1):
        rows = np.flatnonzero((n_left >= back) & (n_right >= min_words - back))
        if len(rows) < 2:
            continue
        key = _runs(common_right, by_right, min_words - back)[rows] * (len(docs) + 1) + _runs(common_left, by_left, back + 1)[rows]
        order = np.lexsort((docs[rows], key))
        rows, key = rows[order], key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        end = np.append(begin[1:], len(rows)) - 1
        low, high = docs[rows[begin]], docs[rows[end]]
        first = np.where(low != high, low, -1)
        out[rows, before - back] = np.repeat(first, end - begin + 1)
    return out


def _compare(min_words: int, seed_words: int):
    """Rows come sorted by head; a group may span batches."""
    width = 2 * min_words - seed_words

    def emit(table: pa.Table):
        flat = pc.split_pattern(table["words"].combine_chunks(), " ").flatten().dictionary_encode()
        missing = flat.dictionary.index("").as_py()
        slots = flat.indices.to_numpy().astype(np.int64).reshape(-1, width)
        names, docs = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
        first = repeated_around(docs, slots, missing, min_words, seed_words)
        edge = np.pad(first, ((0, 0), (1, 1)), constant_values=-1)
        row, low = np.nonzero((first >= 0) & (first != edge[:, :-2]))
        high = np.nonzero((first >= 0) & (first != edge[:, 2:]))[1]
        at = table["at"].to_numpy()[row] - (min_words - seed_words)
        k1 = table["k1"].to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(names[docs[row]]), pa.array(k1), pa.array(at + low), pa.array(at + high), pa.array(names[first[row, low]])], names=["doc_id", "k1", "low", "high", "first"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            table = pa.Table.from_batches(held)
            heads = table["head"].to_numpy()
            if (heads[1:] < heads[:-1]).any():
                raise ValueError("rows of a head are not together")
            last = int(np.searchsorted(heads, heads[-1]))  # the last group may go on
            held, size = table.slice(last).to_batches(), len(heads) - last
            begin = 0
            while begin < last:  # whole groups, about ROWS rows at a time
                end = last if last - begin <= 2 * ROWS else int(np.searchsorted(heads, heads[begin + ROWS], side="right"))
                yield emit(table.slice(begin, end - begin))
                begin = end
        if size:
            yield emit(pa.Table.from_batches(held))

    return work


def repeated_stretches(docs: DataFrame, base: DataFrame, firsts: DataFrame, min_words: int, seed_words: int, hot: int) -> DataFrame:
    """(doc_id, k1, low, high, first): in the text that ``k1`` stands for, every
    stretch of ``min_words`` words that starts at low .. high occurs in two or
    more documents, ``first`` among them. Rows overlap; the lowest ``first`` over
    all rows of a start is the lowest document that holds it."""
    own = base.join(firsts.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"])
    positions = own.select("doc_id", "k1", F.explode("heads").alias("head"))
    # Written first, so that the join has a shuffle of its own on either side and
    # Spark can split a hot passage.
    found = positions.groupBy("head").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a <> b")
    shared = durable(found.select("head", (F.col("n") > hot).alias("hot")))
    met = positions.join(shared, "head").groupBy("doc_id", "k1").agg(F.collect_set(F.struct("head", "hot")).alias("met"))
    around = _keyed(docs).drop("k2").join(met, ["doc_id", "k1"]).mapInArrow(tidy(_contexts(min_words, seed_words)), "doc_id long, k1 long, at long, head long, words string, h binary")
    some_hot = bool(shared.where("hot").head(1))
    around = durable(around) if some_hot else around  # read once where no head is hot
    sorted_rows = around.where("head IS NOT NULL").select("doc_id", "k1", "at", "head", "words").repartition("head").sortWithinPartitions("head")
    compared = sorted_rows.mapInArrow(tidy(_compare(min_words, seed_words)), "doc_id long, k1 long, low long, high long, first long")
    if not some_hot:
        return compared
    counted = around.where("h IS NOT NULL").select("h", "doc_id", "k1", "at")
    twice = durable(counted.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last"))
    return compared.unionByName(counted.join(twice, "h").select("doc_id", "k1", F.col("at").alias("low"), F.col("at").alias("high"), "first"))


def _repeats(docs: DataFrame, min_words: int, seed_words: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, marks) of the texts with repeated stretches, and (doc_id, k1,
    n, rep) of every copy of a text that two documents hold."""
    base = durable(kept_suffixes(docs, min_words, seed_words))
    firsts = base.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    stretches = repeated_stretches(docs, base, firsts, min_words, seed_words, hot)
    marks = stretches.groupBy("doc_id", "k1").agg(F.collect_set(F.struct("low", "high", "first")).alias("marks"))
    copies = base.select("doc_id", "k1", "k2", "n").distinct().join(firsts.where("rep <> last").drop("last"), ["k1", "k2"])
    return marks, copies.select("doc_id", "k1", "n", "rep")


def _starts(marks) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of repeated stretches, and the lowest document of each."""
    low, high, first = (marks.values.field(c).to_numpy() for c in ("low", "high", "first"))
    count = high - low + 1
    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    first = np.repeat(first, count)
    order = np.lexsort((first, at))
    at, first = at[order], first[order]
    once = np.flatnonzero(np.diff(at, prepend=-1))
    return at[once], first[once]


def _spans(min_words: int):
    """Merges the repeated stretches of each text: one span for each run of
    overlapping stretches that have one first document."""

    def work(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, marks in zip(batch.column("doc_id").to_pylist(), batch.column("marks"), strict=True):
                at, first = _starts(marks)
                breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(first) != 0)) + 1
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)], strict=True):
                    rows.append((doc, int(at[a]), int(at[b - 1] - at[a]) + min_words, int(first[a]), bool(first[a] == doc)))
            if rows:
                kinds = (pa.int64(),) * 4 + (pa.bool_(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_words", "first_doc_id", "is_first"])

    return work


def repeated_spans(docs: DataFrame, min_words: int = 50, seed_words: int = 20, hot: int = 32_768) -> DataFrame:
    """Every passage of ``min_words`` or more words that occurs in two or more
    documents: doc_id, start and n_words (in words), first_doc_id (the lowest
    doc_id that holds it), is_first.

    Words are separated by ASCII white space and compared exactly. Copies of a
    whole text of ``min_words`` or more words are one span each. Rows without a
    doc_id, null and empty texts have no spans; repeated rows count once; texts
    that share a doc_id are one document; an empty table gives no rows; other
    columns are ignored.
    """
    marks, copies = _repeats(docs, min_words, seed_words, hot)
    whole = copies.where(F.col("n") >= min_words).select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("n_words"), F.col("rep").alias("first_doc_id"), (F.col("doc_id") == F.col("rep")).alias("is_first"))
    return marks.select("doc_id", "marks").mapInArrow(tidy(_spans(min_words)), SPAN).unionByName(whole)


def _cut(text: str, at: np.ndarray, min_words: int) -> str:
    """What is left of ``text`` without the stretches that start at ``at``."""
    raw = text.encode()
    starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + min_words, -1)
    keep = np.concatenate([[0], np.cumsum(cover[:-1]) == 0, [0]]).astype(np.int8)
    begin, stop = np.flatnonzero(np.diff(keep) == 1), np.flatnonzero(np.diff(keep) == -1)
    lead = [0 if b == 0 else int(starts[b]) for b in begin]
    tail = [len(raw) if e == len(starts) else int(ends[e - 1]) for e in stop]
    return b"\n".join(raw[a:b] for a, b in zip(lead, tail, strict=True)).decode()


def without_repeats(docs: DataFrame, min_words: int = 50, seed_words: int = 20, hot: int = 32_768) -> DataFrame:
    """``docs`` with every repeated passage left in the document of the lowest
    doc_id alone. Later copies of a whole text, and texts of which nothing is
    left, go; other columns stay as they are, whatever their names; n_chars, if
    there, follows the text. What is left around a passage is joined by a line
    feed. Rows without a doc_id are returned unchanged."""
    marks, copies = _repeats(docs, min_words, seed_words, hot)
    names = docs.columns
    doc, key, own, copy = (free_name(n, names) for n in ("doc", "key", "marks", "copy"))
    later = copies.where((F.col("n") >= min_words) & (F.col("doc_id") != F.col("rep")))
    marked = marks.select(F.col("doc_id").alias(doc), F.col("k1").alias(key), F.col("marks").alias(own), F.lit(False).alias(copy))
    none = F.lit(None).cast(marked.schema[own].dataType)
    cuts = marked.unionByName(later.select(F.col("doc_id").alias(doc), F.col("k1").alias(key), none.alias(own), F.lit(True).alias(copy)))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                touched = np.flatnonzero(batch.column(own).is_valid().to_numpy(zero_copy_only=False)).tolist()
                columns = [batch.column(c) for c in names]
                if not touched:
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    continue
                texts = batch.column("text").to_pylist()
                sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else None
                keep = np.ones(batch.num_rows, bool)
                for row in touched:
                    at, first = _starts(batch.column(own)[row])
                    at = at[first != batch.column("doc_id")[row].as_py()]
                    if len(at):
                        texts[row] = _cut(texts[row], at, min_words)
                        keep[row] = bool(texts[row].strip())
                        if sizes is not None:
                            sizes[row] = len(texts[row])
                columns[names.index("text")] = pa.array(texts, pa.string())
                if sizes is not None:
                    columns[names.index("n_chars")] = pa.array(sizes, columns[names.index("n_chars")].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    same = (docs["doc_id"].cast("long") == cuts[doc]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == cuts[key])
    joined = docs.join(cuts, same, "left").where(F.col(copy).isNull() | ~F.col(copy))
    return joined.select(*names, own).mapInArrow(tidy(work), docs.schema)
