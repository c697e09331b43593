"""Exact dedup through an extendible-hash index in the shared folder; DataFrame functions only.

Keys are 64-bit hashes of the normalised text. A directory over their leading bits doubles, level by level, until no bucket holds more
distinct keys than a page. The tasks that own a (bucket, key) compare the bytes of the texts under it: equal hashes of different texts
form a chain. A text meets its copies before the shuffle, in the map-side sets, so a group of copies of any size is small there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, stored, text_of

BLANKS = r"[\x20\x09-\x0D]+"
#: Distinct keys of a page, at least; more when the directory would outgrow its bound.
PAGE_KEYS = 4_096
#: Most leading bits that address the directory, so that it has a bounded size at any number of keys.
DIRECTORY_BITS = 14


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), BLANKS, "")


def directory(keys: DataFrame, page_keys: int = PAGE_KEYS, key_bits: int = 63) -> DataFrame:
    """Slots (slot, bucket, depth) of the directory over the leading bits of ``h``.

    One count per slot of the finest allowed directory is taken in one pass; the doubling then works on these counts: a bucket with more
    keys than a page is split by one more bit until it fits or the bound on bits is met (its keys then chain on one page).
    """
    bits = min(DIRECTORY_BITS, key_bits)
    finest = keys.groupBy(F.shiftright("h", key_bits - bits).alias("slot")).agg(F.approx_count_distinct("h").alias("n"))
    slots = stored(finest.withColumns({"bucket": F.lit(0).cast("long"), "depth": F.lit(0)}), "directory")
    for depth in range(bits):
        loads = slots.groupBy("bucket", "depth").agg(F.sum("n").alias("load"))
        over = loads.where((F.col("load") > page_keys) & (F.col("depth") == depth)).select("bucket", "depth", F.lit(True).alias("over"))
        if over.isEmpty():
            break
        split = F.coalesce("over", F.lit(False))
        slots = stored(
            slots.join(over, ["bucket", "depth"], "left").select(
                "slot", "n", F.when(split, F.shiftright("slot", bits - depth - 1)).otherwise(F.col("bucket")).alias("bucket"), F.when(split, depth + 1).otherwise(F.col("depth")).alias("depth")
            ),
            "directory",
        )
    return slots.select("slot", "bucket", "depth")


def numbered(docs: DataFrame) -> DataFrame:
    """The columns that the index needs, with a row number."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def index(rows: DataFrame, page_keys: int = PAGE_KEYS, key_bits: int = 63) -> tuple[DataFrame, DataFrame]:
    """Entries, one per row of ``rows`` (rid, doc_id, text), and the index, one row per distinct text with its group and the row that stays.

    The group's row has the most code points in the original text, then the smallest id (null ids come last), then the smallest number.
    """
    bits = min(DIRECTORY_BITS, key_bits)
    hashed = rows.select("rid", "doc_id", F.length(text_of()).cast("long").alias("n_chars"), normalised().alias("norm"))
    hashed = hashed.withColumn("h", F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits))
    entries = stored(hashed.select("rid", "doc_id", "n_chars", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "entries")
    slots = F.broadcast(directory(entries.select("h"), page_keys, key_bits))  # 2^14 rows at most
    pages = hashed.select("h", "norm", F.shiftright("h", key_bits - bits).alias("slot")).join(slots, "slot")
    chains = pages.groupBy("bucket", "h").agg(F.sort_array(F.collect_set("norm")).alias("texts")).select("bucket", "h", F.posexplode("texts").alias("chain", "norm"))
    chains = chains.select("bucket", "h", "chain", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid"))
    groups = entries.groupBy("h", "text_sha256").agg(F.count("*").alias("group_size"), best.alias("best"))
    found = chains.join(groups, ["h", "text_sha256"]).select("bucket", "h", "chain", "text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    return entries, stored(found, "index")


def exact_groups(docs: DataFrame, page_keys: int = PAGE_KEYS, key_bits: int = 63) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. Null texts are empty texts and one group; an empty table gives no rows."""
    entries, found = index(numbered(docs), page_keys, key_bits)
    return entries.join(found, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are numbered in a stored copy, since a second scan may number them otherwise when executors come or go.
    """
    tagged = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "tagged")
    _, found = index(tagged.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")))
    return tagged.join(found.select(F.col("keep_rid").alias("rid")), "rid", "left_semi").select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)"""
