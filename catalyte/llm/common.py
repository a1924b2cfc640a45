"""Helpers shared by the operators: durable checkpoints, a cached byte-level
BPE encoder, vectorised word hashing and connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


# --------------------------------------------------------------------------
# durability


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a
    temporary one where none is set, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="catalyte-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Batches that go to Python hold about ``size`` bytes at most, where the
    session has Spark's 64 MB: a task and its worker hold several copies of one."""
    if spark.conf.get(BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH, str(size))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there:
    lineage is cut, and a lost executor takes nothing with it."""
    ensure_checkpoint_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint()


def lowest_by_hash(df: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` distinct (key, ties) of ``df`` whose key hashes lowest, all of
    them where there are fewer. A bound on the hash, from the number of rows,
    leaves each task a handful to send; where keys repeat so much that fewer than
    ``n`` are below it, there is no bound."""
    rows, total = df.select(key, *ties), df.count()
    lowest = lambda some: some.distinct().orderBy(F.xxhash64(key), key, *ties).limit(n)
    if total > 4 * n:
        found = durable(lowest(rows.where(F.xxhash64(key) < -(1 << 63) + int((1 << 64) * 3 * n / total))))
        if found.count() == n:
            return found
    return lowest(rows)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column is called that (Spark
    does not tell upper and lower case apart)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """``batch`` in runs of rows whose text is about ``limit`` bytes at most, so
    that a worker never holds the Python copies of a whole batch of long texts."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    run = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    start = 0
    for end in [*(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


# --------------------------------------------------------------------------
# tokenizer


LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


class _Kept(dict):
    """Values of ``make`` by key; at most ``limit`` short keys are kept (the
    first, hence most frequent)."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.limit and len(key) <= 24:
            self[key] = value
        return value


class PieceEncoder:
    """``tokenizers`` encodings of whole texts, as little-endian uint32 bytes.

    Texts are cut where the vocabulary's pre-tokenizer cuts too, whatever
    follows: before a space that no white space follows, then around words of
    Latin letters, around punctuation marks, and in white space. What is between
    such cuts repeats; each chunk and each part is encoded once and kept.
    """

    PARTS = re.compile(rf"( ?[{LATIN}]++(?![^\W_])| ?[.,;:!?]++(?=\s|\Z|[{LATIN}]))|(\s+(?!\S)| ?\S+|\s+)")
    CUT = re.compile(r" (?=\S)")
    #: White space to Python, but not to the pre-tokenizer; and what it takes out
    #: of a text before it cuts, so that white space ends there.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|endoftext")
    #: What may follow a space in an ASCII text so that there is no cut.
    GAPS = tuple(f" {c}" for c in " \t\n\v\f\r")

    def __init__(self, path: str, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable Latin-1 characters stand for
        # themselves, the other bytes for the characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.chunks = _Kept(self._chunk, limit)
        self.words = _Kept(self._word, limit // 2)
        self.others = _Kept(self._one, limit // 8)

    def _one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A part that the pre-tokenizer leaves whole goes to the model itself."""
        shown = word.replace(" ", self.alphabet[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _parts(self, text: str) -> bytes:
        return b"".join([self.words[w] if w else self.others[x] for w, x in self.PARTS.findall(text)])

    def _chunk(self, chunk: str) -> bytes:
        return self._plain(chunk, " ")

    def _plain(self, chunk: str, lead: str) -> bytes:
        """The ids of ``lead`` and ``chunk``, which is not empty; most are a word, a
        word and a mark, or such on either side of a line feed."""
        core, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,;:!?" else (chunk, "")
        if core.isalpha() and max(core) < "\u0250":
            word = self.words[lead + core]
            return word + self.words[mark] if mark else word
        if "\n" in chunk:
            head, _, tail = chunk.partition("\n")
            if head and not head[-1].isspace() and tail and not tail[0].isspace():
                return (self.chunks[head] if lead else self._plain(head, "")) + self.others["\n"] + self._plain(tail, "")
        return self._parts(lead + chunk)

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.ODD):
            return self._one(text)
        if text.isascii() and not text.endswith(" ") and not any(x in text for x in self.GAPS):
            first, *rest = text.split(" ")
        else:
            first, *rest = self.CUT.split(text)
        return b"".join([self._parts(first), *map(self.chunks.__getitem__, rest)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [self._text(t) for t in texts]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def give_back() -> None:
    """Return memory that is free in this process to the system. A worker waits
    for its next task with all that it once took, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def forget_encoders() -> None:
    """Drop what this process keeps of encodings."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()


def tidy(work, encodes: bool = False):
    """``work`` of a ``mapInArrow`` that leaves no memory behind: what encoders
    keep goes before it starts, unless it ``encodes``, and free memory goes back
    when it ends."""

    def run(batches):
        if not encodes:
            forget_encoders()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


# --------------------------------------------------------------------------
# vectorised word hashes

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words (runs without ASCII white space)."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each range [start, end) of ``values``; equal ranges
    have equal hashes wherever they stand."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_bounds(raw)
    return range_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(count)
    return range_hashes(words, starts, starts + n)


# --------------------------------------------------------------------------
# connected components


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; any orderable
    type), root being the smallest node reachable.

    Alternates "large star" and "small star" steps until no edge changes. Each
    round is checkpointed; a hub's rows are only ever grouped by a minimum, so
    no group is collected.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, last = durable(pairs.distinct()), None
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = durable(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(batches):
    """(a, b): each node of a task's edges and the smallest one it reaches there."""
    ends = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*ends, strict=True)]), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(u):
        x, y = root[u], root[v]
        open_ = x != y
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["a", "b"])


def forest_components(edges: DataFrame, unit: int = 1 << 20) -> DataFrame:
    """``connected_components`` of edges (a, b) of longs that may be many a node:
    tasks of about ``unit`` edges each keep one edge a node, and rounds of joins
    only follow where it takes more than one task. Nodes that edges join to
    themselves alone may be left out. ``edges`` is read twice: it should be written."""
    tasks = -(-edges.count() // unit)
    stars = edges.coalesce(max(1, tasks)).mapInArrow(tidy(_stars), "a long, b long")
    return stars.toDF("node", "root") if tasks <= 1 else connected_components(durable(stars))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
