"""Token ids of whole texts by the tokenizers library, word by distinct word.

A batch of texts is cut at white space in Arrow, its words are made distinct, each distinct word goes through the tokenizer once, and the ids
are laid out again by index. A cut is only made where it can't change the ids: at one space or line break between two other characters.
Every text for which this is not plain (runs of white space, other separators, special tokens, letters beyond Latin) is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from voxtally.llm.shared import give_back_memory

# Spark's slots are the threads; the library's own would wait for each other on the same cores, and each holds memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of text for which words are made distinct together.
CHUNK_CHARS = 6_000_000
#: Words that are sent to the tokenizer as one line.
LINE_WORDS = 256
#: Lines that are encoded before their ids are taken out.
SLAB_LINES = 64
#: White space that is not plain, or text that is empty.
ODD = r"^\z|^[ \n]|[ \n]\z|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: Beyond these, normal forms and lower case may change lengths.
BEYOND_LATIN = r"[^\n\x20-\x{012f}\x{0132}-\x{0177}\x{0179}-\x{017e}]"


def chunks(texts: pa.Array):
    """(first row, row after the last) of stretches of CHUNK_CHARS bytes at most, or of one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_CHARS, "right")))
        yield at, end
        at = end


class WordTokenizer:
    """``encode`` gives the same ids as the tokenizer over each whole text, without special tokens added."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.spaced = spec["normalizer"] is None  # a word's ids hold the space before it
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = spec["model"]["vocab"]
        special = [t["content"] for t in spec["added_tokens"]]
        self.bytes_of = np.zeros(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, np.int64)
        for token, number in vocab.items():
            self.bytes_of[number] = len(token.removesuffix(suffix)) if suffix else len(token)
        for token in spec["added_tokens"]:
            self.bytes_of[token["id"]] = len(token["content"].encode())
        quoted = "|".join(t.replace("|", r"\|") for t in special)
        self.odd = "|".join([ODD, *([quoted] if quoted else []), *([] if self.spaced else [BEYOND_LATIN])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of each text; null counts as empty."""
        ids, lengths = [], []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for at, end in chunks(texts):
            part, n = self._chunk(texts.slice(at, end - at))
            ids.append(part)
            lengths.append(n)
            give_back_memory()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), offsets.astype(np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~odd)
        plain_ids, plain_n = self._words(texts.take(pa.array(rows))) if len(rows) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(rows) == len(texts):
            return plain_ids, plain_n
        n = np.zeros(len(texts), np.int64)
        n[rows] = plain_n
        others = np.flatnonzero(odd)
        whole = self._whole(texts.take(pa.array(others)).to_pylist())
        n[others] = [len(x) for x in whole]
        starts = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[spread(starts[rows], plain_n)] = plain_ids
        for start, x in zip(starts[others].tolist(), whole):
            out[start : start + len(x)] = x
        return out, n

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        broken = pc.replace_substring(texts, "\n", " \n")
        if self.spaced:  # the first word of a text has no space before it; the line break's own id is cut off below
            broken = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), broken, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(broken, " ")
        words = lists.values.dictionary_encode()
        of_text = np.diff(lists.offsets.to_numpy())
        index = words.indices.to_numpy(zero_copy_only=False)
        ids, n = self._distinct(words.dictionary)
        first = np.cumsum(n) - n
        flat = ids[spread(first[index], n[index])]
        ends = np.cumsum(of_text)
        per_text = np.add.reduceat(n[index], ends - of_text)
        if self.spaced:
            starts = np.cumsum(per_text) - per_text
            flat = np.delete(flat, starts)
            per_text = per_text - 1
        return flat, per_text

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word; the cuts between words are found again by the bytes that ids stand for."""
        words = distinct.to_pylist()
        if self.spaced:
            pieces = [w if w[:1] == "\n" else " " + w for w in words]
            lines = ["".join(pieces[k : k + LINE_WORDS]) for k in range(0, len(pieces), LINE_WORDS)]
            size = pc.binary_length(distinct).to_numpy(zero_copy_only=False) + ~pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False)
        else:
            lines = [" ".join(words[k : k + LINE_WORDS]) for k in range(0, len(words), LINE_WORDS)]
            size = pc.binary_length(pc.utf8_lower(pc.ascii_trim(distinct, "\n"))).to_numpy(zero_copy_only=False)
        parts = [np.zeros(0, np.int32)]
        for k in range(0, len(lines), SLAB_LINES):  # an encoding holds much more than its ids
            parts += [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lines[k : k + SLAB_LINES], add_special_tokens=False)]
        ids = np.concatenate(parts)
        seen, want = np.cumsum(self.bytes_of[ids]), np.cumsum(size)
        cut = np.searchsorted(seen, want)
        if len(want) and (seen[-1] != want[-1] or (seen[np.minimum(cut, len(seen) - 1)] != want).any()):
            whole = self._whole([w if self.spaced and w[:1] == "\n" else " " + w for w in words])
            return np.concatenate([np.asarray(x, np.int32) for x in whole]), np.array([len(x) for x in whole], np.int64)
        return ids, np.diff(np.concatenate([[-1], cut])).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run of the given length, in one array."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)
