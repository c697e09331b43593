"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds the letters' vectors, permuted by place;
a text's vector bundles its trigrams; a language's prototype bundles the unit vectors of a bounded, hash-drawn sample of its texts. A text
takes the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, fold, give_back_memory

DIMENSIONS = 1024
SEED = 20_011
#: Texts of a language that its prototype bundles, in expectation; a language of fewer uses all of them.
SAMPLE_PER_LANG = 1_500
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Characters and texts whose counts are held at once.
BATCH_CHARS, BATCH_TEXTS = 800_000, 256
_GRID = 1 << 24
_SLICE = 4_096


class Bundler:
    """Vectors of texts; letters get their numbers and vectors when first met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)  # -1: not looked at yet, 0: no letter
        self.number[0] = 0
        self.places = [self._vector(0)[None, :]] * 3

    def _vector(self, code: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        x = self.number[codes]
        if (x < 0).any():
            new = [c for c in np.unique(codes[x < 0]).tolist()]
            letters = [c for c in new if chr(c).isalpha()]
            self.number[new] = 0
            if letters:
                known = len(self.places[2])
                self.number[letters] = np.arange(known, known + len(letters))
                more = np.stack([self._vector(c) for c in letters])
                self.places = [np.concatenate([old, np.roll(more, 2 - k, axis=1)]) for k, old in enumerate(self.places)]
            x = self.number[codes]
        return x

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One float row per text, zero for a text without letters."""
        joined = "\n\x00\n".join(t.replace("\x00", " ") for t in ["", *texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = codes == 0
        x = self._letters(codes)
        keep = (x != 0) | ends  # one boundary between two runs of letters and beside each end
        keep[1:] |= x[:-1] != 0
        keep[:-1] |= ends[1:]
        keep[1:] |= ends[:-1]
        x, ends = x[keep], ends[keep]
        text = np.cumsum(ends) - 1
        letters = len(self.places[2])
        inside = ~(ends[:-2] | ends[1:-1] | ends[2:]) & ((x[:-2] != 0) | (x[1:-1] != 0) | (x[2:] != 0))
        code = ((x[:-2].astype(np.int64) * letters + x[1:-1]) * letters + x[2:])[inside]
        text = text[:-2][inside]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if not len(code):
            return out
        grams, code = compact(code, letters**3)
        a, b, c = grams // letters**2, grams // letters % letters, grams % letters
        for k in range(0, len(grams), _SLICE):  # in slices, however many distinct trigrams there are
            own = (code >= k) & (code < k + _SLICE) if len(grams) > _SLICE else slice(None)
            part = slice(k, k + _SLICE)
            width = len(grams[part])
            counts = np.bincount(text[own] * width + code[own] - k, minlength=len(texts) * width).reshape(len(texts), width)
            vectors = self.places[0][a[part]] * self.places[1][b[part]] * self.places[2][c[part]]
            out += counts.astype(np.float32) @ vectors.astype(np.float32)
        return out


def compact(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the place of each value among them."""
    if most > 1 << 23:
        return np.unique(code, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[code] = True
    values = np.flatnonzero(seen)
    place = np.zeros(most, np.int32)
    place[values] = np.arange(len(values), dtype=np.int32)
    return values, place[code]


@functools.lru_cache(maxsize=2)
def bundler(dimensions: int) -> Bundler:
    return Bundler(dimensions)


def batches_of(texts: pa.Array):
    """(first row, texts) in batches of bounded size; lower case, null as empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        end = max(at + 1, min(at + BATCH_TEXTS, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_CHARS, "right"))))
        yield at, pc.utf8_lower(pc.fill_null(texts.slice(at, end - at), "")).to_pylist()
        at = end


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(norm == 0, 1, norm)


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order and a unit vector for each, from texts with a language outside the held-out fold.

    The sample is drawn by a hash of the id against ``per_lang`` over the language's count. Sums are taken in whole steps of 2^-24, so that
    reruns agree; what reaches the driver is one vector for each language.
    """
    own = docs.where(F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, dimensions))
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = own.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def sums(batches):
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in batches_of(batch.column(1)):
                steps = np.rint(unit(bundler(dimensions).bundle(texts)) * _GRID).astype(np.int64)
                for k, row in enumerate(steps):
                    own[langs[at + k]] = own.get(langs[at + k], 0) + row
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([v.tolist() for v in own.values()], pa.list_(pa.int64()))], names=["lang", "steps"])

    parts = sample.mapInArrow(sums, "lang string, steps array<long>").select("lang", F.posexplode("steps").alias("place", "steps"))
    whole = parts.groupBy("lang", "place").agg(F.sum("steps").alias("steps")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "steps"))).alias("v"))
    found = {r["lang"]: [s for _, s in r["v"]] for r in whole.collect()}
    langs = sorted(found)
    return langs, unit(np.array([found[k] for k in langs], np.float64).reshape(len(langs), dimensions))


def predicted(docs: DataFrame, langs: list[str], vectors: np.ndarray):
    """Column of (lang_pred, score) of the column ``text``: und with 0 where there is no letter or nothing was learned; ties take the first language."""
    dimensions = vectors.shape[1]
    model = docs.sparkSession.sparkContext.broadcast(([*langs, UNKNOWN], vectors.T.astype(np.float32)))

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, columns = model.value
        best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        for at, part in batches_of(texts):
            bundles = bundler(dimensions).bundle(part)
            some = bundles.any(axis=1)
            if len(names) > 1 and some.any():
                cosine = unit(bundles) @ columns
                rows = np.arange(at, at + len(part))[some]
                best[rows] = cosine[some].argmax(axis=1)
                score[rows] = np.clip(cosine[some].max(axis=1), 0, 1)
        give_back_memory()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(best)), pa.array(score)], names=["lang_pred", "score"])

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. An empty table gives no rows; without any learned language all rows are und."""
    langs, vectors = prototypes(docs)
    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), predicted(docs, langs, vectors).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows that op2 does not call und. Columns stay as they are.

    A text of a language that was not learned takes the nearest prototype and stays: a cosine does not tell it from a short clean text.
    """
    langs, vectors = prototypes(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predicted(docs, langs, vectors).alias("p"))
    return rows.where(F.col("p.lang_pred") != UNKNOWN).select("row.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
