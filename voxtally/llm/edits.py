"""Token counts that follow edits: a segment tree of token counts per document.

A text is cut into segments at single white space between other characters, where a byte-level tokenizer's pre-tokens end in any case, so the
segments' counts add up to the text's. A tree over the segments keeps sums of characters and tokens. An edit finds its segments by descending
the sums of characters, joins what it touches, takes in neighbours while a cut beside it is no longer safe, and only that region is encoded
again; the sums above it are updated.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, stored, text_of
from voxtally.llm.tokens import WordTokenizer, word_tokenizer

TOKENIZER = "byte_bpe_50k.json"
#: Characters after which a segment ends at the next safe cut.
SEGMENT_CHARS = 192
CHUNK_CHARS = 4_000_000
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
EDIT = "array<struct<at:long,removed:long,inserted:string>>"
TREE_SCHEMA = "rid long, doc_id long, text string, segment_chars array<int>, segment_tokens array<int>, n_tokens long"


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Pieces of the text in order; every piece but the first starts with the white space of its cut."""
    cuts, at = [0], 0
    while (m := _CUT.search(text, at + size)) is not None:
        at = m.start()
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])] if text else []


def safe(left: str, right: str) -> bool:
    """Whether no pre-token crosses from left to right: one blank or line break between two characters that aren't white space."""
    return not left[-1].isspace() and right[0] in " \n" and len(right) > 1 and not right[1].isspace()


class SegmentTree:
    """Sums over pieces: ``chars`` and ``tokens`` as heaps whose leaves are the pieces; an emptied piece stays as an empty leaf."""

    def __init__(self, pieces: list[str], tokens: list[int]):
        self.pieces = list(pieces) or [""]
        self.leaves = 1 << (len(self.pieces) - 1).bit_length()
        self.chars = self._sums([len(p) for p in self.pieces])
        self.tokens = self._sums(list(tokens) or [0])
        self.stale: set[int] = set()

    def _sums(self, values: list[int]) -> list[int]:
        heap = [0] * self.leaves + values + [0] * (self.leaves - len(values))
        for k in range(self.leaves - 1, 0, -1):
            heap[k] = heap[2 * k] + heap[2 * k + 1]
        return heap

    def _set(self, heap: list[int], leaf: int, value: int) -> None:
        k = leaf + self.leaves
        change = value - heap[k]
        while k and change:
            heap[k] += change
            k >>= 1

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with characters, at the end) and the place inside it."""
        if at >= self.chars[1]:
            leaf = self._beside(self.leaves, -1)
            return (0, 0) if leaf is None else (leaf, len(self.pieces[leaf]))
        k = 1
        while k < self.leaves:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.leaves, at

    def put(self, leaf: int, piece: str) -> None:
        self.pieces[leaf] = piece
        self._set(self.chars, leaf, len(piece))
        self.stale.add(leaf)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on; both are clipped to the text."""
        at = min(max(at, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - at)
        first, start = self.find(at)
        last, end = self.find(at + removed) if removed else (first, start)
        if last == first:
            own = self.pieces[first]
            self.put(first, own[:start] + inserted + own[end:])
            return
        self.put(first, self.pieces[first][:start] + inserted + self.pieces[last][end:])
        for leaf in range(first + 1, last + 1):
            if self.pieces[leaf]:
                self.put(leaf, "")

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with characters to the left or right, by climbing and descending the sums."""
        k = leaf + self.leaves if leaf < self.leaves else None
        if k is None:  # from behind the last leaf
            if not self.chars[1]:
                return None
            k = 1
        else:
            while k > 1 and (k % 2 == (0 if step < 0 else 1) or not self.chars[k ^ 1]):
                k >>= 1
            if k <= 1:
                return None
            k ^= 1
        while k < self.leaves:
            near, far = (2 * k + 1, 2 * k) if step < 0 else (2 * k, 2 * k + 1)
            k = near if self.chars[near] else far
        return k - self.leaves

    def settle(self) -> list[int]:
        """Join pieces around stale ones until every cut beside them is safe; the leaves to encode again. Emptied leaves count no tokens."""
        todo = sorted(self.stale)
        due = set()
        for leaf in todo:
            if not self.pieces[leaf]:
                self._set(self.tokens, leaf, 0)
                due.discard(leaf)
        for leaf in todo:
            if not self.pieces[leaf]:
                continue
            while (other := self._beside(leaf, -1)) is not None and not safe(self.pieces[other], self.pieces[leaf]):
                self._join(other, leaf, due)
                leaf = other
            while (other := self._beside(leaf, 1)) is not None and not safe(self.pieces[leaf], self.pieces[other]):
                self._join(leaf, other, due)
            due.add(leaf)
        # two pieces that met because everything between them went away
        for leaf in todo:
            if not self.pieces[leaf]:
                left = self._beside(leaf, -1)
                right = self._beside(leaf, 1)
                if left is not None and right is not None and not safe(self.pieces[left], self.pieces[right]):
                    self._join(left, right, due)
                    due.add(left)
        self.stale.clear()
        return sorted(due)

    def _join(self, left: int, right: int, due: set[int]) -> None:
        self.put(left, self.pieces[left] + self.pieces[right])
        self.put(right, "")
        self._set(self.tokens, right, 0)
        due.discard(right)


def _chunks(texts: pa.Array):
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_CHARS, "right")))
        yield at, end
        at = end


def counted(words: WordTokenizer, texts: pa.Array) -> list[tuple[list[str], list[int]]]:
    """Segments of each text and their token counts: the whole text's ids, cut where their bytes meet the segments' ends."""
    ids, offsets = words.encode(texts)
    seen = np.concatenate([[0], np.cumsum(words.bytes_of[ids])])
    out = []
    for k, text in enumerate(texts.to_pylist()):
        pieces = segments(text or "")
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in pieces]) + seen[offsets[k]]
        out.append((pieces, np.diff(np.searchsorted(seen, ends), prepend=offsets[k]).tolist()))
    return out


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """rid, doc_id, text with the characters and tokens of its segments (the leaves of its tree) and all its tokens; null counts as empty."""

    def build(batches):
        words = word_tokenizer(tokenizer_path)
        for batch in batches:
            for at, end in _chunks(batch.column(2)):
                part = batch.slice(at, end - at)
                trees = counted(words, part.column(2))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([[len(p) for p in pieces] for pieces, _ in trees], ints), pa.array([n for _, n in trees], ints), pa.array([sum(n) for _, n in trees], pa.int64())],
                    names=["rid", "doc_id", "text", "segment_chars", "segment_tokens", "n_tokens"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    return rows.mapInArrow(build, TREE_SCHEMA)


def apply_edits(trees: DataFrame, edits: Column, tokenizer_path: str) -> DataFrame:
    """rid, doc_id, the counts before and after, and how much was encoded again.

    ``edits`` is a column of each row: (at, removed, inserted), one after the other, each on the text as the one before left it. Places and
    lengths are clipped to the text, nulls count as 0 and empty; without edits nothing is encoded.
    """
    return _edited(trees, edits, tokenizer_path, False)


def edited_trees(trees: DataFrame, edits: Column, tokenizer_path: str) -> DataFrame:
    """The trees after the edits of :func:`apply_edits`, in the shape of :func:`build_trees`, for the next round of edits.

    Store them between rounds; segments that an edit emptied are left out. A row without edits keeps its tree.
    """
    return _edited(trees, edits, tokenizer_path, True)


def _edited(trees: DataFrame, edits: Column, tokenizer_path: str, whole: bool) -> DataFrame:
    counts = "rid long, doc_id long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, encoded_chars long, encoded_segments long"

    def run(batches):
        tokenizer = word_tokenizer(tokenizer_path).tokenizer
        for batch in batches:
            for at, end in _chunks(batch.column(2)):
                part = batch.slice(at, end - at)
                columns = [part.column(k).to_pylist() for k in range(2, 7)]
                grown, due = [], []
                for text, chars, tokens, _, changes in zip(*columns):
                    ends = np.cumsum(chars).tolist()
                    tree = SegmentTree([text[b - n : b] for b, n in zip(ends, chars)], tokens)
                    for change in changes or []:
                        if change is not None:
                            tree.edit(change["at"] or 0, change["removed"] or 0, change["inserted"] or "")
                    grown.append(tree)
                    due.append(tree.settle())
                again = [tree.pieces[leaf] for tree, leaves in zip(grown, due) for leaf in leaves]
                fresh = iter([len(e.ids) for e in tokenizer.encode_batch_fast(again, add_special_tokens=False)])
                for tree, leaves in zip(grown, due):
                    for leaf in leaves:
                        tree._set(tree.tokens, leaf, next(fresh))
                many = lambda values: pa.array(values, pa.int64())
                if whole:
                    left = [[(p, t.tokens[t.leaves + k]) for k, p in enumerate(t.pieces) if p] for t in grown]
                    ints = pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0), part.column(1), pa.array(["".join(p for p, _ in pieces) for pieces in left], pa.string()), pa.array([[len(p) for p, _ in pieces] for pieces in left], ints),
                            pa.array([[n for _, n in pieces] for pieces in left], ints), many([t.tokens[1] for t in grown]),
                        ],
                        names=["rid", "doc_id", "text", "segment_chars", "segment_tokens", "n_tokens"],
                    )
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(5), many([len(c or []) for c in columns[4]]), many([t.chars[1] for t in grown]), many([t.tokens[1] for t in grown]),
                        many([sum(len(t.pieces[leaf]) for leaf in leaves) for t, leaves in zip(grown, due)]), many([len(leaves) for leaves in due]),
                    ],
                    names=["rid", "doc_id", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "encoded_chars", "encoded_segments"],
                )

    return trees.select("rid", "doc_id", "text", "segment_chars", "segment_tokens", "n_tokens", edits.cast(EDIT).alias("edits")).mapInArrow(run, TREE_SCHEMA if whole else counts)


def sample_edits() -> Column:
    """Three edits of each text by its own characters: words put in at a third, a stretch replaced at the half, a stretch taken out near the end."""
    n = F.length("text")

    def edit(at: Column, removed: int, inserted: Column) -> Column:
        return F.struct(F.floor(at).cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))

    return F.array(edit(n / 3, 0, F.lit(" (edited) ")), edit(n / 2, 40, F.substring("text", 1, 30)), edit(n * 0.9, 25, F.lit("")))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over all documents, then three edits of each: doc_id and the counts before and after."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    trees = stored(build_trees(documents(spark, sf_dir), path), "trees")
    return apply_edits(trees, sample_edits(), path).drop("rid")
