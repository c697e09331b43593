"""Near-duplicates by BagMinHash: signatures of multisets of word shingles, bands of them, and an exact check of the multisets' overlap.

A shingle of weight w owns one Poisson process per level of a ladder of weights (1, 2, 4, ...), with a rate of the level's width; points above
w are thinned out. Every point falls into one place of the signature, where the earliest one wins: two texts agree in a place with a chance
equal to their weighted Jaccard. Points are only drawn up to the time by which all places are filled, so their number hardly grows with a text.

Texts with equal multisets are one class from the start. In each bucket of a band the members are compared with one hub, the member that
shares the most buckets; only members that end in different components of these links are then compared across components, which finds every
link of the buckets without all pairs. Before whole texts are compared, a pair has to agree in LEAST_AGREEING places of the signature.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.graph import components
from voxtally.llm.shared import documents, give_back_memory, id_key, stored
from voxtally.llm.tokens import spread

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Of 80 places, a pair of similarity 0.8 agrees in 64 on average, with a deviation of 3.6; fewer than this have a chance below one in a million.
LEAST_AGREEING = 44
#: Members of a bucket, on average, in a block.
BLOCK_ROWS = 256
#: Characters of text that are held as arrays at once.
CHUNK_CHARS = 2_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0x3C6EF372FE94F82A, 0xDAA66D2C7DDEF743], np.uint64)
_SIGNED = "rid long, doc_id long, text string, n_shingles long, key_a long, key_b long, bands array<long>, sketch binary"


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and weight, ordered by text and shingle.

    Words are runs of other characters than white space, in lower case. A text of one to four words has one shingle of all of them; a text
    without words has none.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    words = lists.values.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    some = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False)  # an empty text leaves one
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[some]
    h = hashes[words.indices.to_numpy(zero_copy_only=False)][some] if len(some) else np.zeros(0, np.uint64)
    n = np.bincount(text, minlength=len(texts))
    many = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), many)
    at = spread(first, many)
    value = np.full(len(at), np.uint64(SHINGLE_WORDS))
    for k in range(SHINGLE_WORDS):
        inside = at + k < (first + n)[owner]
        value = np.where(inside, mix64(value * _GOLDEN + h[np.minimum(at + k, len(h) - 1)]) if len(h) else value, value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return owner[starts], value[starts], np.diff(np.append(starts, len(owner)))


def bag_minhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signature of each text: the number of the earliest point in each place; zeros for a text without shingles."""
    total = np.bincount(owner, weights=weight, minlength=texts)
    best = np.full(texts * size, np.inf)
    point = np.zeros(texts * size, np.uint64)
    levels = np.frexp(weight - 0.5)[1].clip(0) + 1  # of the ladder, up to the one that holds the weight
    process = np.repeat(np.arange(len(owner)), levels)
    level = spread(np.zeros(len(owner), np.int64), levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    seed = mix64(shingle[process] + (level.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    horizon = size * (np.log(size) + 3) / np.maximum(total, 1)
    pending = total > 0
    while pending.any():
        active = np.flatnonzero(pending[owner[process]])
        state, time = seed[active].copy(), np.zeros(len(active))
        own, most, lo, wide = owner[process[active]], weight[process[active]], low[active], width[active]
        until = horizon[own]
        while len(state):
            state = state + _GOLDEN
            draw = mix64(state)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / wide
            alive = time <= until
            state, time, draw, own, most, lo, wide, until = (v[alive] for v in (state, time, draw, own, most, lo, wide, until))
            other = mix64(draw ^ np.uint64(0x5851F42D4C957F2D))
            real = lo + (other >> np.uint64(40)).astype(np.int64) % wide < most
            place = own[real] * size + (other[real] & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            at, number = time[real], draw[real]
            np.minimum.at(best, place, at)
            won = best[place] == at
            point[place[won]] = number[won]
        short = np.isinf(best.reshape(texts, size)).any(axis=1) & pending
        horizon[short] *= 2
        again = np.repeat(short, size)
        best[again] = np.inf
        pending = short
    return point.reshape(texts, size)


def _chunks(texts: pa.Array):
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_CHARS, "right")))
        yield at, end
        at = end


def _sign(batches):
    """Number of shingles, two sums that stand for the multiset, and one hash per band."""
    for batch in batches:
        for at, end in _chunks(batch.column(2)):
            part = batch.slice(at, end - at)
            owner, value, weight = shingles(part.column(2))
            many = len(part)
            total = np.bincount(owner, weights=weight, minlength=many).astype(np.int64)
            keys = []
            for salt in (0, 1):
                sums = np.zeros(many, np.uint64)
                np.add.at(sums, owner, mix64(value + _SALTS[salt]) * mix64(weight.astype(np.uint64) + _SALTS[1 - salt]))
                keys.append(sums.view(np.int64))
            signature = bag_minhash(owner, value, weight, many, BANDS * ROWS).reshape(many, BANDS, ROWS)
            bands = np.full((many, BANDS), np.uint64(17))
            for k in range(ROWS):
                bands = mix64(bands * _GOLDEN + signature[:, :, k])
            offsets = pa.array(np.arange(many + 1) * BANDS, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))
            low = np.ascontiguousarray(signature.reshape(many, -1).astype(np.uint8))
            sketch = pa.array([row.tobytes() for row in low], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(total), pa.array(keys[0]), pa.array(keys[1]), lists, sketch, *part.columns[3:]],
                names=["rid", "doc_id", "text", "n_shingles", "key_a", "key_b", "bands", "sketch", *part.schema.names[3:]],
            )
        give_back_memory()


@functools.lru_cache(maxsize=64)
def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, value, weight = shingles(pa.array([text], pa.large_string()))
    return value, weight


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard of the two texts' multisets of shingles."""
    return overlap_of(_bag(a), _bag(b))


def overlap_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (va, wa), (vb, wb) = a, b
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = int(np.minimum(wa[ia], wb[ib]).sum())
    either = int(wa.sum() + wb.sum()) - both
    return both / either if either else 1.0


def _agreeing(least: int):
    """Pairs whose signatures, a byte of each place, agree in ``least`` places or more."""

    def check(batches):
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)]
            keep = pa.array(np.flatnonzero((sides[0] == sides[1]).sum(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return check


def _verify(similarity: float):
    def check(batches):
        for batch in batches:
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            score = np.array([overlap(a or "", b or "") for a, b in texts], np.float64)
            keep = np.flatnonzero(score >= similarity)
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(score[keep])], names=["a", "b", "similarity"])

    return check


def verified(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts overlap as much as asked; sizes and signatures that rule this out drop a pair before any text moves."""
    size = signed.select("rid", "n_shingles", "sketch")
    pairs = pairs.join(size.withColumnsRenamed({"rid": "a", "n_shingles": "na", "sketch": "sa"}), "a").join(size.withColumnsRenamed({"rid": "b", "n_shingles": "nb", "sketch": "sb"}), "b")
    pairs = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * (similarity - 1e-9)).select("a", "b", "sa", "sb")
    pairs = stored(pairs.mapInArrow(_agreeing(LEAST_AGREEING), "a long, b long"), "pairs")
    text = signed.select("rid", "text")
    rows = pairs.join(text.withColumnsRenamed({"rid": "b", "text": "text_b"}), "b").join(text.withColumnsRenamed({"rid": "a", "text": "text_a"}), "a")
    return stored(rows.select("a", "b", "text_a", "text_b").mapInArrow(_verify(similarity), "a long, b long, similarity double"), "verified")


def _blocks_of(batches):
    """Rows of one pair of blocks of one bucket at a time, from batches in that order."""
    key, held = None, []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        marks = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if key != (now := tuple(marks[a])):
                if held:
                    yield key, pa.concat_tables(held).combine_chunks()
                key, held = now, []
            held.append(table.slice(a, b - a))
    if held:
        yield key, pa.concat_tables(held).combine_chunks()


def _candidates(key: tuple, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to compare: of different components, not the bucket's hub, met first in this band, near in size and signature.

    In a pair of different blocks only pairs across them count; the others are met where a block is paired with itself.
    """
    i, j = np.triu_indices(rows.num_rows, 1)
    rid, hub, block, top, size = (rows.column(c).to_numpy() for c in ("rid", "hub", "block", "top", "n_shingles"))
    keep = (top[i] != top[j]) & (rid[i] != hub[i]) & (rid[j] != hub[j]) & (np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * (SIMILARITY - 1e-9))
    if key[2] != key[3]:
        keep &= block[i] != block[j]
    i, j = i[keep], j[keep]
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    bands = np.array(rows.column("bands").combine_chunks().values).reshape(rows.num_rows, -1)
    near = (sketch[i] == sketch[j]).sum(axis=1) >= LEAST_AGREEING
    i, j = i[near], j[near]
    first = (bands[i] == bands[j]).argmax(axis=1) == key[0]
    return i[first], j[first]


def _active(batches):
    """Members of each pair of blocks that have a pair to compare."""
    for key, rows in _blocks_of(batches):
        found = np.unique(np.concatenate(_candidates(key, rows)))
        if len(found):
            yield from rows.take(pa.array(found)).to_batches()


def _compare(similarity: float):
    """Links of each pair of blocks; a pair whose components other links have joined meanwhile tells nothing new."""

    def links(batches):
        for key, rows in _blocks_of(batches):
            texts, rid, top = rows.column("text").to_pylist(), rows.column("rid").to_pylist(), rows.column("top").to_pylist()
            joined: dict[int, int] = {}

            def find(k):
                while k in joined:
                    k = joined[k]
                return k

            bags = functools.cache(lambda k: _bag(texts[k] or ""))
            out = []
            for i, j in zip(*(side.tolist() for side in _candidates(key, rows))):
                a, b = find(top[i]), find(top[j])
                if a != b and (score := overlap_of(bags(i), bags(j))) >= similarity:
                    joined[max(a, b)] = min(a, b)
                    out.append((min(rid[i], rid[j]), max(rid[i], rid[j]), score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])

    return links


def across(placed: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b, similarity) between members of a bucket that are in different components so far.

    A bucket of many members is dealt in blocks, each pair of blocks being one group; pairs are compared inside a group and only links leave
    it. Texts are fetched for the members that have a pair left after sizes and signatures.
    """
    mixed = placed.groupBy("band", "bucket").agg(F.min("top").alias("main"), F.max("top").alias("last"), F.count("*").alias("n")).where("main < last")
    mixed = mixed.select("band", "bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = placed.join(mixed, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = ["band", "bucket", "low", "high"]
    rows = rows.select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rid", "hub", "top", "block")
    facts = signed.select("rid", "n_shingles", "sketch", "bands")
    columns = "band int, bucket long, low int, high int, rid long, hub long, top long, block int, n_shingles long, sketch binary, bands array<long>"
    dealt = rows.join(facts, "rid").select(*[c.split()[0] for c in columns.split(", ")]).repartition(*order).sortWithinPartitions(*order)
    active = stored(dealt.mapInArrow(_active, columns), "active")
    texts = active.join(signed.select("rid", "text"), "rid").select(*active.columns, "text").repartition(*order).sortWithinPartitions(*order)
    return texts.mapInArrow(_compare(similarity), "a long, b long, similarity double")


def signed_documents(rows: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, text) with their signatures' bands and the key of their multiset, in the shared folder; further columns come along, behind."""
    kept = ["rid", "doc_id", "text"]
    own = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in rows.columns if c not in kept])
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in own.schema.fields[3:])
    return stored(own.mapInArrow(_sign, _SIGNED + more), "signed")


def classes(signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """rid, top: the row that stands for the class of each row.

    Bands and the agreement of signatures are made for SIMILARITY; any larger similarity is as safe, a smaller one would lose links and raises.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"signatures are banded for similarities from {SIMILARITY} on, not {similarity}")
    copies = signed.groupBy("key_a", "key_b", "n_shingles").agg(F.min("rid").alias("first"))
    members = signed.select("rid", "key_a", "key_b", "n_shingles").join(copies, ["key_a", "key_b", "n_shingles"]).select("rid", "first")
    members = stored(members, "members")
    singles = copies.where("n_shingles > 0").select(F.col("first").alias("rid"))
    banded = signed.select("rid", F.posexplode("bands").alias("band", "bucket")).join(singles, "rid", "left_semi")
    # a bucket of one row has no pair
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    banded = stored(banded.join(shared, ["band", "bucket"]).select("band", "bucket", "rid", "n"), "buckets")
    # the text that others are near to shares more with them than they do with each other
    central = banded.groupBy("rid").agg(F.sum("n").alias("company"))
    hub = banded.join(central, "rid").groupBy("band", "bucket").agg(F.max(F.struct("company", (-F.col("rid")).alias("less"))).alias("hub")).select("band", "bucket", (-F.col("hub.less")).alias("hub"))
    banded = stored(banded.select("band", "bucket", "rid").join(hub, ["band", "bucket"]), "buckets")
    hubs = banded.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    links = verified(hubs, signed, similarity)
    top = stored(components(links), "components")
    placed = banded.join(top.withColumnRenamed("node", "rid"), "rid", "left").select("band", "bucket", "rid", "hub", F.coalesce("top", "rid").alias("top"))
    more = stored(across(placed, signed, similarity), "across")
    whole = stored(components(links.unionByName(more).select("a", "b")), "components")
    return members.join(whole, members["first"] == whole["node"], "left").select("rid", F.coalesce("top", "first").alias("top"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row: classes are the connected components of overlaps of ``similarity`` or more.

    The class id is the smallest id in the class (a null id counts as the smallest and gives a null class id); one row of each class is kept,
    the first of those with that id. Null texts are empty; texts without words are copies of each other. An empty table gives no rows.
    """
    signed = signed_documents(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"))
    rows = stored(classes(signed, similarity).join(signed.select("rid", "doc_id"), "rid").withColumn("k", id_key()), "classes")
    per = rows.groupBy("top").agg(F.min(F.struct("k", "rid")).alias("stays"), F.count("*").alias("class_size"))
    per = per.select("top", F.col("stays.rid").alias("keep_rid"), "class_size", F.when(F.col("stays.k") != F.lit(-(2**63)), F.col("stays.k")).alias("class_id"))
    return rows.join(per, "top").select("doc_id", "class_id", "class_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the first by id, with all columns of ``docs``. Texts are stored once, beside their signatures."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    signed = signed_documents(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", rest.alias("rest")))
    rows = classes(signed, similarity).join(signed.select("rid", id_key().alias("k")), "rid")
    stay = rows.groupBy("top").agg(F.min(F.struct("k", "rid")).alias("stays")).select(F.col("stays.rid").alias("rid"))
    kept = signed.select("rid", "text", "rest").join(stay, "rid", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
