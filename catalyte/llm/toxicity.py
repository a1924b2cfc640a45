"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word boundaries) and itself,
hashed into a fixed number of buckets; a text is cut into windows of words, a
window's vector is the average of its words' subword embeddings, and a linear
softmax gives its toxicity. A document is as toxic as its most toxic window, so
that long documents do not drown a passage. Embeddings and softmax are trained
jointly in numpy with Adagrad; misspellings nobody has seen share n-gram vectors
with the words they come from.

At scoring time the two-class softmax needs one number per bucket (embedding
times weight difference), so the model that is broadcast has a fixed size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, lowest_by_hash, mix, range_hashes, slices, texts_of, tidy

WORD = re.compile(r"\w+")
NGRAMS = (3, 4, 5)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(words: list[str], buckets: int, step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the n-grams of every word, and how many each word has;
    ``step`` words at a time, as each takes many times its own memory."""
    parts = [_subwords(words[at : at + step], buckets) for at in range(0, len(words), step)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    padded = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    ids, owner = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            many = np.maximum(lengths - n + 1, 0)
            at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
            value = np.full(len(at), n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + codes[at + k]
            ids.append(mix(value) % np.uint64(buckets))
            owner.append(np.repeat(np.arange(len(words)), many))
        ids.append(range_hashes(codes, starts, starts + lengths) % np.uint64(buckets))  # the whole word
        owner.append(np.arange(len(words)))
    ids, owner = np.concatenate(ids).astype(np.int32), np.concatenate(owner)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """One number per bucket, the bias, and the window length in words."""

    value: np.ndarray
    bias: float
    window: int

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = subwords(words, len(self.value))
        sums = np.add.reduceat(self.value[ids].astype(np.float64), np.cumsum(counts) - counts) if len(words) else np.zeros(0)
        return sums, counts.astype(np.float64)


def pooled(sums: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Averages of the half-overlapping windows of one text, and their starts."""
    n = len(sums)
    starts = np.arange(0, max(1, n - window // 2), window // 2)
    ends = np.minimum(starts + window, n)
    a, b = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0.0], np.cumsum(counts)])
    return (a[ends] - a[starts]) / np.maximum(b[ends] - b[starts], 1), starts


def train(texts: list[str], labels: np.ndarray, dims: int = 8, buckets: int = 1 << 17, window: int = 4, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4, least: int | None = None, seed: int = 0) -> Model:
    """Joint training of embeddings and softmax on labelled texts. Buckets that
    fewer than ``least`` of them use are left out: by default a tenth of the rarer
    label's texts, two at least and five at most."""
    if not len(labels) or labels.min() == labels.max() or not any(map(words_of, texts)):
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), window)
    if least is None:
        least = int(np.clip(min(labels.sum(), len(labels) - labels.sum()) // 10, 2, 5))
    random = np.random.default_rng(seed)
    index: dict[str, int] = {}
    lists = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    subs, counts = subwords(list(index), buckets)
    first = np.cumsum(counts) - counts
    # Buckets that fewer than `least` documents use stay zero: what one document
    # alone shows is no evidence.
    spread = np.zeros(buckets, np.int32)
    for own in map(np.unique, lists):
        many = counts[own]
        at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        spread[np.unique(subs[at])] += 1
    known = spread >= least
    # Windows as ranges over the words of some documents, about 200,000 at a time.
    half, chunks, held = window // 2, [[]], 0
    for d, own in enumerate(lists):
        if held > 200_000:
            chunks.append([])
            held = 0
        chunks[-1].append(d)
        held += len(own)

    def ranges(docs: list[int]):
        flat = np.concatenate([lists[d] for d in docs])
        many = np.array([len(lists[d]) for d in docs])
        starts = [np.arange(0, max(1, n - half), half) for n in many.tolist()]
        count = np.array(list(map(len, starts)))
        doc = np.repeat(np.arange(len(docs)), count)
        base = np.repeat(np.cumsum(many) - many, count)
        begins = np.concatenate(starts)
        ends = np.minimum(begins + window, many[doc])
        sums = np.concatenate([[0], np.cumsum(counts[flat])])
        total = np.maximum(sums[base + ends] - sums[base + begins], 1)
        return flat, (base + begins).astype(np.int32), (base + ends).astype(np.int32), doc.astype(np.int32), np.cumsum(count) - count, total.astype(np.int32), labels[docs]

    parts = [ranges(docs) for docs in chunks]
    del lists
    embed = random.normal(0, 0.1, (buckets, dims)) * known[:, None]
    weight = random.normal(0, 0.5, (dims, 2))
    bias = np.zeros(2)
    speed_e, speed_w, speed_b = np.full(buckets, 1e-8), np.full((dims, 2), 1e-8), np.full(2, 1e-8)
    balance = np.array([0.5 / (1 - labels.mean()), 0.5 / labels.mean()])
    for step in range(rounds):
        difference = weight[:, 1] - weight[:, 0]
        per_bucket = (embed @ difference).astype(np.float32)
        per_word, pull = np.zeros(len(index)), 0.0
        word_score = np.add.reduceat(per_bucket[subs], first, dtype=np.float64)
        heat = 1.0 + 4.0 * step / rounds
        for flat, begins, ends, doc, doc_start, total, own in parts:
            sums = np.concatenate([[0.0], np.cumsum(word_score[flat])])
            score = (sums[ends] - sums[begins]) / total + bias[1] - bias[0]
            # Soft maximum over a document's windows, harder as training goes on.
            share = np.exp(heat * (score - np.maximum.reduceat(score, doc_start)[doc]))
            share /= np.add.reduceat(share, doc_start)[doc]
            value = np.add.reduceat(share * score, doc_start)
            gap = (1 / (1 + np.exp(-value)) - own) * balance[own] / len(labels)
            g = gap[doc] * share  # gradient of each window's score
            pull += g.sum()
            part = g / total
            each = np.cumsum(np.bincount(begins, part, len(flat) + 1) - np.bincount(ends, part, len(flat) + 1))[:-1]
            per_word += np.bincount(flat, each, len(index))
        per_sub = np.zeros(buckets)
        for a in range(0, len(index), 50_000):  # the words' subwords take far more memory than they
            b = min(a + 50_000, len(index))
            end = first[b] if b < len(index) else len(subs)
            per_sub += np.bincount(subs[first[a] : end], np.repeat(per_word[a:b], counts[a:b]), buckets)
        grad_w = embed.T @ per_sub
        on = np.flatnonzero(known & (per_sub != 0))
        grad_e = per_sub[on, None] * difference + decay * embed[on]
        speed_e[on] += (grad_e**2).mean(axis=1)
        embed[on] -= rate * grad_e / np.sqrt(speed_e[on])[:, None]
        for param, grad, speed in ((weight, np.stack([-grad_w, grad_w], axis=1), speed_w), (bias, np.array([-pull, pull]), speed_b)):
            speed += grad**2
            param -= rate * grad / np.sqrt(speed)
    difference = weight[:, 1] - weight[:, 0]
    return Model((embed @ difference).astype(np.float32), float(bias[1] - bias[0]), window)


class Scorer:
    """Scores texts with kept word sums (``limit`` words at most)."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit, self.known = model, limit, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        new = list(set().union(*lists) - self.known.keys()) if lists else []
        sums, counts = self.model.word_sums(new)
        fresh = dict(zip(new, zip(sums.tolist(), counts.tolist(), strict=True), strict=True))
        if len(self.known) + len(fresh) <= self.limit:
            self.known.update(fresh)
            look = self.known.__getitem__
        else:
            extra, known = fresh, self.known
            look = lambda w: extra[w] if w in extra else known[w]
        out = np.empty(len(texts))
        for at, own in enumerate(lists):
            if own:
                pairs = np.array(list(map(look, own)))
                average, _ = pooled(pairs[:, 0], pairs[:, 1], self.model.window)
                out[at] = average.max() + self.model.bias
            else:
                out[at] = min(self.model.bias, 0.0)
        return 1 / (1 + np.exp(-out))


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 50_000) -> tuple[list[str], np.ndarray]:
    """The bounded sample the model is fitted on: of the labelled documents of 1
    to ``longest`` characters ``per_class`` of each class, those of the lowest
    hash, or all where there are fewer. A document labelled both ways is left
    out; each distinct text counts once, as toxic if any of its ids is."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    one = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text").between(1, longest))
    one = durable(one.join(texts.select("doc_id"), "doc_id", "left_semi"))
    few = [lowest_by_hash(one.where(F.col("toxic") == c), "doc_id", per_class, "toxic") for c in (0, 1)]
    # at most twice per_class ids
    rows = texts.join(F.broadcast(few[0].union(few[1])), "doc_id").collect()
    kept = {r["text"]: r["toxic"] for r in sorted(rows, key=lambda r: (r["toxic"], r["doc_id"], r["text"]))}
    return list(kept), np.array(list(kept.values()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """The model for ``docs`` from the rows of ``labels`` (doc_id, toxic). Null,
    empty and unlabelled texts teach nothing, repeated texts count once; with
    labels of one kind or none the score is the bias."""
    return train(*labelled_texts(docs, labels, per_class))


def score(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``limit``) for every row of
    ``docs``, over whole texts. Null and empty texts get the bias alone, never
    over one half; repeated rows stay; other columns are ignored."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list[Scorer] = []

    def work(batches):
        scorer = kept[0] if kept else Scorer(shared.value)
        kept[:] = [scorer]
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(texts_of(batch.column("text"))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit``, all columns as they
    are."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield batch.filter(pa.array(scorer(texts_of(batch.column("text"))) < limit))

    return docs.mapInArrow(tidy(work), docs.schema)
