"""Token ids of a corpus in range-coded files, in ascending id order, and their reader.

A shard holds one range of document ids as a table of frames in the shared folder; any task can read any frame. A frame is self-describing:
magic, version, block size, counts, then ids and lengths of its whole documents, then the size and crc32 of each block, then the payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.coder import decode_blocks, encode_blocks
from voxtally.llm.shared import documents, new_path
from voxtally.llm.tokens import word_tokenizer

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1024
#: Ids after which a frame is closed; a document stays in one frame.
FRAME_TOKENS = 3_000_000
_HEAD = struct.Struct("<4sHHIII")
_MAGIC, _VERSION = b"VXTK", 1
FRAME_SCHEMA = "shard int, frame int, n_tokens long, body binary"


def build_frame(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    payloads, crcs = encode_blocks(ids, block)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    names = doc_ids.fill_null(0).to_numpy().astype("<i8")
    return b"".join([
        _HEAD.pack(_MAGIC, _VERSION, 0, block, len(lengths), len(payloads)), np.packbits(null).tobytes(), names.tobytes(), lengths.astype("<u8").tobytes(),
        np.array([len(p) for p in payloads], "<u4").tobytes(), np.array(crcs, "<u4").tobytes(), *payloads,
    ])


def read_frame(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, lengths and all token ids; a damaged frame raises ValueError."""
    magic, version, _, block, docs, blocks = _HEAD.unpack_from(body)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a frame of token ids")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(body, kind, n, at)
        at += part.nbytes
        return part

    null = np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)
    names, lengths = take("<i8", docs), take("<u8", docs).astype(np.int64)
    sizes, crcs = take("<u4", blocks), take("<u4", blocks)
    ends = at + np.cumsum(sizes.astype(np.int64))
    payloads = [body[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist())]
    total = int(lengths.sum())
    ids = decode_blocks(payloads, [min(block, total - block * k) for k in range(blocks)], crcs.tolist())
    if len(ids) != total:
        raise ValueError("a frame of token ids is cut off")
    return pa.array(names, pa.int64(), mask=null), lengths, ids


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block: int = BLOCK, frame_tokens: int = FRAME_TOKENS) -> None:
    """Write the frames of all documents under ``path``: null ids first, then ascending; rows of one id in the order of their texts.

    Null and empty texts have the end id alone. An empty table writes no frame.
    """

    def frames(batches):
        words = word_tokenizer(tokenizer_path)
        names, lengths, ids, held, number, shard = [], [], [], 0, 0, 0

        def close():
            nonlocal names, lengths, ids, held, number
            flat = np.concatenate(ids)
            body = build_frame(pa.concat_arrays(names), np.concatenate(lengths), flat, block)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([body], pa.binary())], names=["shard", "frame", "n_tokens", "body"])
            names, lengths, ids, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            flat, offsets = words.encode(batch.column(1))
            n = np.diff(offsets) + 1
            flat = np.insert(flat, offsets[1:], end_id)
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                done = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + frame_tokens - held, "right")))
                names.append(batch.column(0).slice(at, end - at))
                lengths.append(n[at:end])
                ids.append(flat[done : ends[end - 1]])
                held += int(ends[end - 1] - done)
                at = end
                if held >= frame_tokens or at < len(n):
                    yield close()
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("shard", F.spark_partition_id())
    ordered.mapInArrow(frames, FRAME_SCHEMA).write.parquet(path, compression="none")


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def documents_of(batches):
        for batch in batches:
            for shard, frame, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                names, lengths, ids = read_frame(body.as_py())
                starts = np.cumsum(lengths) - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(starts.tolist(), lengths.tolist())]
                many = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.full(many, shard), pa.int32()), pa.array(np.full(many, frame), pa.int32()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "frame", "at", "n_tokens", "ids_crc32"],
                )

    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    decoded = frames.select("shard", "frame", "body").mapInArrow(documents_of, "doc_id long, shard int, frame int, at long, n_tokens long, ids_crc32 long")
    sizes = frames.select("shard", "frame", "n_tokens")
    # one row per shard is ordered in one task; frames are ordered inside their shard
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("own"))
    shards = shards.select("shard", (F.sum("own").over(Window.partitionBy().orderBy("shard")) - F.col("own")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_tokens")
    places = sizes.select("shard", "frame", inside.alias("inside")).join(shards, "shard")
    return decoded.join(places, ["shard", "frame"]).select("doc_id", (F.col("before") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), path)
    return read_tokens(spark, path)
