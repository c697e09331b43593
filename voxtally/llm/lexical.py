"""Ranked lexical search over a length-stratified index.

Documents of one normaliser ``m`` form a stratum; its postings are lists of documents by (term, tf), so that a term's impact is one number a
list. Neighbouring strata share a shelf until it holds SHELF_POSTINGS postings, a larger stratum is dealt over slots, and a task scores a
(shelf, slot) at a time. A query visits its shelves by their bounds, what the largest tf of its terms in each stratum could add up to: first
FIRST_SHELVES of them, then those whose bound reaches the score of the last document that the first visit ranked.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, stored

#: Postings, a document and one of its terms, of a shelf, about; a larger stratum is dealt over as many slots as it fills.
SHELF_POSTINGS = 400_000
FIRST_SHELVES = 4
#: Queries whose scores are held as one array.
BLOCK_QUERIES = 128
LISTED = 50
_APART = bytes(b for b in range(128) if not chr(b).isalnum())
#: A-Z in lower case, all ASCII between terms blank, other bytes as they are.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _APART, bytes(range(97, 123)) + b" " * len(_APART))
_POSTINGS = "shelf long, slot long, m long, term string, tf long, docs array<long>"
_FOUND = "query long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def term_counts(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with n, all terms of a text, its ``different`` ones, those as ``words``, blanks between, and their counts ``tfs``."""

    def count(batches):
        for batch in batches:
            sizes, kinds, words, tfs = [], [], [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found = Counter(terms_of(text or b""))
                sizes.append(found.total())
                kinds.append(len(found))
                words.append(b" ".join(found))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)).tobytes())
            columns = [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(kinds, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n", "different", "words", "tfs"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(column, *keep).mapInArrow(count, f"{kept}, n long, different long, words string, tfs binary")


@dataclass
class Index:
    """``postings`` (shelf, slot, m, term, tf, docs) with documents numbered inside a slot; the list of the empty term names their doc_id."""

    postings: DataFrame
    documents: int
    terms: int


def _post(batches):
    """Postings of every (shelf, slot), whose rows come in a run; a task holds the rows of one."""
    key, held = None, []
    for batch in batches:
        shelf, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(shelf) != 0) | (np.diff(slot) != 0)) + 1
        for start, end in zip([0, *edges], [*edges, len(shelf)]):
            if start == end:
                continue
            if (shelf[start], slot[start]) != key and held:
                yield _slot_postings(key, pa.Table.from_batches(held))
                held = []
            key = (shelf[start], slot[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield _slot_postings(key, pa.Table.from_batches(held))


def _slot_postings(key: tuple[int, int], rows: pa.Table) -> pa.RecordBatch:
    rows = rows.sort_by([("doc_id", "ascending")])  # nulls last
    words = b" ".join(rows["words"].cast(pa.binary()).to_pylist()).split()
    tf = np.frombuffer(b"".join(rows["tfs"].to_pylist()), np.int64)
    named = pa.array(words, pa.binary()).dictionary_encode()
    code = named.indices.to_numpy().astype(np.int64)
    sizes = np.array([len(t) // 8 for t in rows["tfs"].to_pylist()])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    m = np.repeat(rows["m"].to_numpy(), sizes)
    order = np.lexsort((doc, tf, m, code))
    code, m, tf, doc = code[order], m[order], tf[order], doc[order]
    first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(m) != 0) | (np.diff(tf) != 0)])
    lists = pa.array([*first.tolist(), len(doc), len(doc) + len(sizes)], pa.int32())
    docs = pa.ListArray.from_arrays(lists, pa.concat_arrays([pa.array(doc, pa.int64()), rows["doc_id"].combine_chunks().cast(pa.int64())]))
    terms = pa.concat_arrays([named.dictionary.take(pa.array(code[first])), pa.array([b""], pa.binary())]).cast(pa.string())
    ends = [pa.array(np.r_[x[first], 0], pa.int64()) for x in (m, tf)]
    n = len(docs)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), ends[0], terms, ends[1], docs], names=["shelf", "slot", "m", "term", "tf", "docs"])


def build(docs: DataFrame) -> Index:
    """The index of (doc_id, text), written to the shared folder. Texts without a term, null ones too, are not in it."""
    counted = stored(term_counts(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), "text", ["doc_id"]).where("n > 0"), "terms")
    number, terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = counted.withColumn("m", F.expr(f"100 - 50 + (50 * n * {number}L) div {max(terms, 1)}L")).withColumn("row", F.monotonically_increasing_id())
    # one row a stratum: their number follows the longest text, not the documents
    strata = placed.groupBy("m").agg(F.sum("different").alias("held"))
    upto = F.sum("held").over(Window.orderBy("m")) - F.col("held")
    strata = strata.select("m", F.floor(upto / SHELF_POSTINGS).alias("shelf"), F.ceil(F.col("held") / SHELF_POSTINGS).alias("slots"))
    slots = placed.join(strata, "m").select("shelf", F.pmod(F.xxhash64("row"), "slots").alias("slot"), "m", "doc_id", "words", "tfs")
    postings = slots.repartition("shelf", "slot").sortWithinPartitions("shelf", "slot").mapInArrow(_post, _POSTINGS)
    return Index(stored(postings, "postings"), number, terms)


def _best(scores: np.ndarray, least: np.ndarray, listed: int):
    """Row, place and score of the ``listed`` highest of each row, the first places on ties, of those that reach ``least``."""
    for row, (line, floor) in enumerate(zip(scores, least)):
        at = np.flatnonzero(line >= max(floor, 1))
        if len(at) > listed:
            last = np.partition(line[at], -listed)[-listed]
            above, ties = at[line[at] > last], at[line[at] == last]
            at = np.r_[above, ties[: listed - len(above)]]
        yield row, at, line[at]


def _scorer(listed: int):
    def score(postings: pa.Table, visits: pa.Table) -> pa.Table:
        """The best documents of one slot for every query that visits it."""
        empty = pc.equal(postings["term"], "")
        ids = postings.filter(empty)["docs"].combine_chunks().flatten() if len(postings) else pa.array([], pa.int64())
        postings = postings.filter(pc.invert(empty)).sort_by("term")
        queries, at, found = visits["query"].to_numpy(), [], []
        named = postings["term"].combine_chunks()
        terms = pc.unique(named)
        docs = postings["docs"].combine_chunks()
        sizes = docs.value_lengths().to_numpy().astype(np.int64)
        place = docs.flatten().to_numpy()
        tf, m = postings["tf"].to_numpy().astype(np.int64), postings["m"].to_numpy().astype(np.int64)
        worth = np.repeat((1_000_000_000 * tf) // (1000 * tf + 20 * m), sizes)
        code = pc.index_in(named, terms).to_numpy()
        lists = np.r_[0, np.cumsum(sizes)][np.searchsorted(code, np.arange(len(terms) + 1))]
        for block in range(0, len(queries), BLOCK_QUERIES):
            part = visits.slice(block, BLOCK_QUERIES)
            asked = part["terms"].combine_chunks()
            known = pc.fill_null(pc.index_in(asked.flatten(), terms), -1).to_numpy()
            who = np.repeat(np.arange(len(part)), asked.value_lengths().to_numpy())
            weight = part["weights"].combine_chunks().flatten().to_numpy()
            order = np.argsort(known, kind="stable")
            bounds = np.searchsorted(known[order], np.arange(len(terms) + 1))
            scores = np.zeros((len(part), len(ids)), np.int64)
            for t in np.flatnonzero(np.diff(bounds)):
                own, here = order[bounds[t] : bounds[t + 1]], slice(lists[t], lists[t + 1])
                scores[who[own][:, None], place[here]] += weight[own][:, None] * worth[here]
            for row, best, points in _best(scores, part["floor"].to_numpy(), listed):
                found.append((np.full(len(best), queries[block + row]), points))
                at.append(best)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.array([], np.int64)] * 2
        ids = ids.take(pa.array(np.concatenate(at) if at else [], pa.int64()))
        return pa.table([pa.array(columns[0], pa.int64()), ids, pa.array(columns[1], pa.int64())], names=["query", "doc_id", "score"])

    return score


def search(index: Index, queries: DataFrame, listed: int = LISTED) -> DataFrame:
    """query, rank, doc_id, score: the ``listed`` best documents with a score above 0 for every row of ``queries`` (query, text).

    ``query`` is unique. Equal scores rank by doc_id, null last; rows of one doc_id are documents of their own. A null text, one without a
    term and one whose terms are in no document find nothing.
    """
    number = index.documents
    asked = stored(term_counts(queries, "text", ["query"]).select("query", F.explode(F.split("words", " ")).alias("term")).where("term <> ''"), "queries")
    wanted = asked.select("term").distinct()
    postings = stored(index.postings.where("term <> ''").join(wanted, "term", "left_semi"), "wanted")
    # one row a term and stratum
    tops = stored(postings.groupBy("term", "shelf", "m").agg(F.max("tf").alias("tf"), F.sum(F.size("docs")).alias("held")), "tops")
    df = tops.groupBy("term").agg(F.sum("held").alias("df"))
    weighed = df.withColumn("w", F.floor(F.lit(1000.0) * F.log(F.lit(2 * number + 2).cast("double") / (F.lit(2) * F.col("df") + 1)))).where("w > 0")
    asked = stored(asked.join(weighed.select("term", "w"), "term"), "weighed")
    most = F.expr("sum(w * ((1000000000 * tf) div (1000 * tf + 20 * m)))").alias("bound")
    shelves = asked.join(tops, "term").groupBy("query", "shelf", "m").agg(most).groupBy("query", "shelf").agg(F.max("bound").alias("bound"))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "shelf")
    shelves = stored(shelves.withColumn("visit", F.row_number().over(order)), "bounds")
    names = index.postings.where("term = ''")
    vectors = asked.groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))

    def visit(chosen: DataFrame) -> DataFrame:
        slots = names.select("shelf", "slot").join(chosen.select("query", "shelf", "floor"), "shelf").join(vectors, "query")
        lists = postings.unionByName(names).join(chosen.select("shelf").distinct(), "shelf", "left_semi")
        grouped = lists.groupBy("shelf", "slot").cogroup(slots.groupBy("shelf", "slot"))
        return grouped.applyInArrow(_scorer(listed), _FOUND)

    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = stored(visit(shelves.where(F.col("visit") <= FIRST_SHELVES).withColumn("floor", F.lit(1).cast("long"))), "found")
    floors = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == listed).select("query", F.col("score").alias("floor"))
    rest = shelves.where(F.col("visit") > FIRST_SHELVES).join(floors, "query", "left").fillna(1, ["floor"]).where("bound >= floor")
    found = first.unionByName(stored(visit(rest), "found"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= listed).select("query", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; an item row of a repeated or null id is a query of its own."""
    items = stored(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text", F.monotonically_increasing_id().alias("query")), "items")
    found = search(build(documents(spark, sf_dir)), items.select("query", "text"))
    return found.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0), total AS (SELECT count(*)::HUGEINT AS nn, sum(n)::HUGEINT AS l FROM held),
m AS (SELECT r, doc_id, (50 + (50 * n * nn) // l)::BIGINT AS m FROM held, total),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM held) GROUP BY 1, 2),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN weights USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, r HAVING score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 50"""
