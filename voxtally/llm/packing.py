"""Best-fit packing of documents into sequences of bounded length, planned over the histogram of piece lengths.

A document's pieces are tokenized and counted on the executors. Only the histogram, at most one count per length, reaches the driver: best fit
decreasing runs over counts there and leaves a plan of slot runs. Pieces then take their slots by joining on their rank within the length.
A length shared by any part of all pieces is ranked in salted groups, so that no task orders a whole length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, new_path, stored
from voxtally.llm.tokens import chunks, spread, word_tokenizer

SEQUENCE_TOKENS = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces that one ranked group holds on average.
GROUP_PIECES = 4_000
LEAST_SALTS = 512


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ids of the text and an end id, cut from the end into pieces of ``size``, so that only the first is shorter.

    Null and empty texts have the end id alone; null ids stay null; repeated rows give their own pieces.
    """

    def cut(batches):
        words = word_tokenizer(tokenizer_path)
        for part in (batch.slice(at, end - at) for batch in batches for at, end in chunks(batch.column(1))):
            ids, offsets = words.encode(part.column(1))
            n = np.diff(offsets) + 1
            whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
            pieces = -(-n // size)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = spread(np.zeros(len(n), np.int64), pieces)
            first = n - (pieces - 1) * size
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            length = np.where(piece == 0, first[row], size)
            at = (np.cumsum(n) - n)[row] + start
            raw = memoryview(whole.tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())), np.int64, len(at))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def plan_slots(histogram: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts.

    Each run (length, first rank, last rank + 1, first sequence, pieces per sequence, offset) places pieces of one length into successive
    sequences. Sequences that look alike are one entry (free space, first sequence, how many), so work follows the lengths, not the pieces.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # free space, first sequence, sequences; sorted
    next_sequence = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(open_, (length, -1, -1))
            if at < len(open_):
                free, first, many = open_.pop(at)
            else:
                free, first = size, next_sequence
                many = -(-left // (size // length))
                next_sequence += many
            fit = free // length
            full = min(many, left // fit)
            if full:
                runs.append((length, rank, rank + full * fit, first, fit, size - free))
                rank += full * fit
                left -= full * fit
                if free - fit * length:
                    bisect.insort(open_, (free - fit * length, first, full))
            if left and full < many:  # fewer than fill one more
                runs.append((length, rank, rank + left, first + full, left, size - free))
                if free - left * length:
                    bisect.insort(open_, (free - left * length, first + full, 1))
                full, left = full + 1, 0
            if full < many:
                bisect.insort(open_, (free, first + full, many - full))
    return runs


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Rank of each piece among those of its length: its rank in a salted group plus the sizes of the groups before."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "tag"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = salted.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "tag")) - 1)
    return inside.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "salt")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    An empty table gives no rows. Ties inside a length are ordered by id, piece and content; which of equal rows comes first doesn't matter.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, size, end_id), "pieces").withColumn("tag", F.monotonically_increasing_id())
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = plan_slots(histogram, size)
    plan = spark.createDataFrame(runs, "length int, rank_from long, rank_to long, first_sequence long, fit long, base long")
    salts = max(LEAST_SALTS, sum(histogram.values()) // (GROUP_PIECES * max(1, len(histogram))))
    placed = ranked(pieces, salts).join(plan, "length").where("rank >= rank_from AND rank < rank_to")
    inside = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(inside / F.col("fit"))).alias("sequence_id"), (F.col("base") + inside % F.col("fit") * F.col("length")).alias("offset"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
