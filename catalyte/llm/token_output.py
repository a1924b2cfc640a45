"""Token-id output: blocks of separately compressed documents that share one
zstandard dictionary.

File format. A written table of blocks (any file system Spark writes to; its
commit protocol makes a lost executor's half-written files invisible). A block
holds consecutive documents of one shard, shards and blocks ascend by doc_id:

    magic  4 bytes  "CTB1"
    width  1 byte   bytes of one id (2 or 4)
    sha    32 bytes SHA-256 of the dictionary its frames need
    n      uint32   documents
    ids    n int64  doc_id (null: the smallest int64)
    counts n uint32 ids of each document, end id included
    ends   n uint32 offset index: where each frame ends
    frames          one zstandard frame for each document

The dictionary is trained on the serialized id arrays of a bounded sample and
stored beside the blocks. One document is read with ``read_document``: header,
one index entry, one frame.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, encoder, ensure_checkpoint_dir, lowest_by_hash, slices, texts_of

MAGIC = b"CTB1"
NULL_ID = -(1 << 63)
HEAD = 4 + 1 + 32 + 4


def serialize(raw: bytes, width: int) -> bytes:
    """Little-endian uint32 ids as ``width`` bytes each."""
    return raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary; plain content where the samples are too few to
    train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0"


def compressor(dictionary: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)


def write_block(rows: list[tuple[int | None, int, bytes]], width: int, sha: bytes) -> bytes:
    """One block of (doc_id, number of ids, frame) in the given order."""
    ids = np.array([NULL_ID if d is None else d for d, _, _ in rows], "<i8")
    counts = np.array([n for _, n, _ in rows], "<u4")
    ends = np.cumsum([len(f) for _, _, f in rows]).astype("<u4")
    head = MAGIC + bytes([width]) + sha + len(rows).to_bytes(4, "little")
    return b"".join([head, ids.tobytes(), counts.tobytes(), ends.tobytes(), *(f for _, _, f in rows)])


def block_index(block: bytes) -> tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, int]:
    """Width, dictionary hash, doc ids, counts, frame ends, start of frames."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    n = int.from_bytes(block[37:41], "little")
    ids = np.frombuffer(block, "<i8", n, HEAD)
    counts = np.frombuffer(block, "<u4", n, HEAD + 8 * n)
    ends = np.frombuffer(block, "<u4", n, HEAD + 12 * n)
    return block[4], block[5:37], ids, counts, ends, HEAD + 16 * n


def read_document(block: bytes, at: int, expand: zstandard.ZstdDecompressor) -> bytes:
    """The ids (little-endian uint32) of the document at index ``at``."""
    width, _, _, counts, ends, frames = block_index(block)
    begin = int(ends[at - 1]) if at else 0
    raw = expand.decompress(block[frames + begin : frames + int(ends[at])], max_output_size=int(counts[at]) * width)
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def frames_of(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, dictionary: bytes) -> DataFrame:
    """(doc_id, key, n, frame) of every row: a hash of its text, the number of its
    ids with ``end_id``, and their compressed frame."""

    def work(batches):
        squeeze = compressor(dictionary)
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids = [raw + tail for raw in encoder(tokenizer_path).encode(texts_of(batch.column("text")))]
                frames = [squeeze.compress(serialize(raw, width)) for raw in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array([len(raw) // 4 for raw in ids], pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "key", "n", "frame"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, key long, n long, frame binary")


def write_token_blocks(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, sample_docs: int = 1000, sample_chars: int = 20_000, block_bytes: int = 4 << 20, shard_bytes: int = 32 << 20, shards: int | None = None
) -> None:
    """Writes every document of ``docs`` below ``path`` (folders ``blocks`` and
    ``dictionary``), in ascending doc_id order over all shards.

    The first ``sample_chars`` characters of ``sample_docs`` rows fit the
    dictionary; everything else covers all rows, whole texts. Texts are encoded
    and compressed where they lie; only frames are shuffled. Shards hold about
    ``shard_bytes`` of them.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    ids = lowest_by_hash(rows, "doc_id", sample_docs)
    some = rows.join(F.broadcast(ids), "doc_id").select("doc_id", F.substring("text", 1, sample_chars).alias("text")).orderBy("doc_id", "text").limit(sample_docs).collect()
    dictionary = train_dictionary([serialize(x, width) for x in encoder(tokenizer_path).encode([r["text"] or "" for r in some])])
    sha = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(dictionary), sha.hex())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")

    def work(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        waiting: list[tuple[int | None, int, bytes]] = []
        held = block = before = 0

        def flush():
            n = sum(x for _, x, _ in waiting)
            return n, pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([write_block(waiting, width, sha)], pa.binary())],
                names=["shard", "block", "before", "n_tokens", "data"],
            )

        for batch in batches:
            for doc, n, frame in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("frame"), strict=True):
                waiting.append((doc, n, frame.as_py()))
                held += frame.as_buffer().size
                if held >= block_bytes:
                    n, out = flush()
                    yield out
                    waiting, held, block, before = [], 0, block + 1, before + n
        if waiting:
            yield flush()[1]

    frames = durable(frames_of(docs, tokenizer_path, end_id, width, dictionary))
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    n = shards or max(1, -(-size // shard_bytes))
    order = (F.col("doc_id").asc_nulls_first(), F.col("key"))
    ordered = frames.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(work, "shard int, block int, before long, n_tokens long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, one row per document: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32. An empty table gives no rows."""
    stored = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, sha = bytes(stored["dictionary"]), bytes.fromhex(stored["sha256"])
    if hashlib.sha256(dictionary).digest() != sha:
        raise ValueError("the dictionary does not have its hash")
    blocks = spark.read.parquet(f"{path}/blocks")
    # A block says how many ids of its shard come before it, so that one number
    # a shard is all that has to be known elsewhere.
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    starts = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[s] for s in sorted(sizes))]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast(starts)

    def work(batches):
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for shard, start, data in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("data"), strict=True):
                data = data.as_py()
                width, found, ids, counts, ends, frames = block_index(data)
                if found != sha:
                    raise ValueError("a block needs another dictionary")
                begin, crcs = 0, []
                for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
                    raw = expand.decompress(data[frames + begin : frames + end], max_output_size=count * width)
                    wide = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    crcs.append(zlib.crc32(wide))
                    begin = end
                before = shared.value[shard] + start + np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NULL_ID), pa.array(before.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(np.array(crcs, np.int64))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("shard", "before", "data").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared checkpoint folder and reads
    the files back: doc_id, start, n_tokens, ids_crc32 for every row.

    Null and empty texts are documents of the end id alone; rows without a
    doc_id come first; repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/token-output-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer_path, end_id)
    return read_token_blocks(spark, path)
