"""Order MinHash: signatures of whole texts that follow edit distance, not only shared content; DataFrame functions only.

A text's k-mers of words are numbered by occurrence and hashed once. Each of the signature's hash functions is a rotation of that hash on a
ring; it selects the next few k-mers from its point on, puts them back into text order and hashes the tuple. All steps work inside a row, in
time that follows the text (two sorts of long values), so no group of rows is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.shared import NULL_ID, documents, id_key, stored, text_of

#: Words are runs of other characters than white space; longer runs are cut, so that text without blanks has words too.
WORD = r"[^\s]{1,12}"
KMER_WORDS = 3
SIGNATURE = 64
_POSITION_BITS = 24
_POSITION = (1 << _POSITION_BITS) - 1


def _kmers(df: DataFrame, text: str) -> DataFrame:
    """Hash of each k-mer; a text of fewer words has one k-mer of all of them, an empty one has none."""
    df = df.withColumn("omh_w", F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    many = F.transform(
        F.slice("omh_w", 1, F.greatest(F.size("omh_w") - (KMER_WORDS - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("omh_w", i + j) for j in range(1, KMER_WORDS)])
    )
    few = F.when(F.size("omh_w") > 0, F.array(F.xxhash64("omh_w"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("omh_k", F.when(F.size("omh_w") >= KMER_WORDS, many).otherwise(few)).drop("omh_w")


def signature(df: DataFrame, text: str, out: str, size: int = SIGNATURE) -> DataFrame:
    """Adds ``out``, an array of ``size`` hashes of ordered pairs of k-mers. An empty text has a signature of zeros.

    A text of one k-mer pairs it with itself. Positions beyond 2^24 words share one place in the order.
    """
    df = _kmers(df, text)
    at = lambda i: F.least(i, F.lit(_POSITION)).cast("long")
    packed = F.transform("omh_k", lambda h, i: F.shiftleft(h, _POSITION_BITS).bitwiseOR(at(i)))
    df = df.withColumn("omh_p", F.sort_array(packed)).withColumn("omh_n", F.size("omh_k")).drop("omh_k")
    kmer = lambda x: F.shiftright(x, _POSITION_BITS)
    starts = F.filter(F.sequence(F.lit(0), F.col("omh_n") - 1), lambda i: (i == 0) | (kmer(F.get("omh_p", i)) != kmer(F.get("omh_p", i - 1))))
    df = df.withColumn("omh_s", F.when(F.col("omh_n") > 0, starts).otherwise(F.array().cast("array<int>")))
    # rank keys: 39 bits of the hash of (k-mer, occurrence), then the position
    key = lambda x, o: F.shiftleft(F.shiftrightunsigned(F.xxhash64(kmer(x), o), 25), _POSITION_BITS).bitwiseOR(x.bitwiseAND(F.lit(_POSITION)))
    runs = F.transform("omh_s", lambda s, j: F.transform(F.slice("omh_p", s + 1, F.coalesce(F.get("omh_s", j + 1), F.col("omh_n")) - s), key))
    df = df.withColumn("omh_r", F.sort_array(F.flatten(runs))).drop("omh_p", "omh_s")
    step = 1 << (63 - (size.bit_length() - 1))
    points = F.array(*[F.lit(b * step).cast("long") for b in range(size)])
    df = df.withColumn("omh_m", F.sort_array(F.concat("omh_r", points)))
    # two references keep the sorted column apart from the lambda, which would sort again for every element
    found = F.filter(F.sequence(F.lit(0), F.size("omh_m") - 1), lambda i: F.get("omh_m", i).bitwiseAND(F.lit(step - 1)) == 0)
    df = df.withColumn("omh_i", found).drop("omh_m")

    def pair(i: Column, b: Column) -> Column:
        a, c = F.get("omh_r", (i - b) % F.col("omh_n")), F.get("omh_r", (i - b + 1) % F.col("omh_n"))
        first = a.bitwiseAND(F.lit(_POSITION)) <= c.bitwiseAND(F.lit(_POSITION))
        return F.xxhash64(kmer(F.when(first, a).otherwise(c)), kmer(F.when(first, c).otherwise(a))).bitwiseAND(F.lit(0xFFFFFFFF))

    empty = F.array_repeat(F.lit(0).cast("long"), size)
    return df.withColumn(out, F.when(F.col("omh_n") > 0, F.transform("omh_i", pair)).otherwise(empty)).drop("omh_r", "omh_i", "omh_n")


def likeness(a: str, b: str, size: int = SIGNATURE) -> Column:
    """Share of equal places."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(a, i) == F.get(b, i))) / F.lit(float(size))


def as_text(sig: str) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """k, prev, prev_n of each distinct id: the id before it in descending order and the longest text there; the first follows the last.

    Ids are range-partitioned and ordered inside their range; only the ends of the ranges, one row each, are ordered together.
    """
    distinct = ids.groupBy("k").agg(F.max("n").alias("n"))
    ranges = stored(distinct.repartitionByRange(F.desc("k")).withColumn("range", F.spark_partition_id()), "ids")
    ends = ranges.groupBy("range").agg(F.min("k").alias("last"), F.min_by("n", "k").alias("last_n"))
    order, everything = Window.partitionBy().orderBy("range"), Window.partitionBy().orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range", F.coalesce(F.lag("last").over(order), F.first("last").over(everything)).alias("before"), F.coalesce(F.lag("last_n").over(order), F.first("last_n").over(everything)).alias("before_n")
    )
    inside = Window.partitionBy("range").orderBy(F.desc("k"))
    own = ranges.select("k", "range", F.lag("k").over(inside).alias("own"), F.lag("n").over(inside).alias("own_n"))
    return own.join(ends, "range").select("k", F.coalesce("own", "before").alias("prev"), F.coalesce("own_n", "before_n").alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with the fingerprints of its text and its edited text, and their likenesses.

    A null text is an empty one; a null id counts as the smallest. Rows that repeat an id all get their own row; the text that follows an id
    is the smallest one of the next id. A single document is its own next one. An empty table gives no rows.
    """
    base = docs.select(id_key().alias("k"), text_of().alias("text"))
    chain = stored(neighbours(base.select("k", F.length("text").alias("n"))), "neighbours")
    # both sides below read the same columns, so that signatures are made, and texts dealt out, once
    signed = signature(base, "text", "sig").repartition("k")
    heads = signed.join(chain, "k").select(F.col("prev").alias("k"), F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 3).cast("int")).alias("head"), F.col("sig").alias("next_sig"))
    heads = heads.groupBy("k").agg(F.min(F.struct("head", "next_sig")).alias("next"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    joined = signed.join(heads, "k").select(
        F.when(F.col("k") != F.lit(NULL_ID), F.col("k")).alias("doc_id"), n.cast("long").alias("n_chars"), "sig", F.col("next.next_sig").alias("next_sig"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.head", F.lit(1), cut)).alias("edited"),
    )
    both = signature(joined, "edited", "edited_sig")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
