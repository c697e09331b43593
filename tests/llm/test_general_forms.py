"""General interfaces beyond the registered queries: trees that go on, null ids in reply trees, bounds of similarity, signatures by hand."""

import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from voxtally.llm import chat, edits, fingerprint, neardup  # noqa: E402
from voxtally.llm.shared import NULL_ID, stored  # noqa: E402
from voxtally.llm.tokens import word_tokenizer  # noqa: E402


def test_trees_after_edits_take_the_next_edits(docs_of, hard):
    path = public_tokenizers.path(edits.TOKENIZER)
    tokenizer = word_tokenizer(path).tokenizer
    trees = stored(edits.build_trees(docs_of(hard), path), "trees")
    want = [(doc, text or "") for doc, text, *_ in hard]
    for _ in range(3):
        trees = stored(edits.edited_trees(trees, edits.sample_edits(), path), "trees")
        after = []
        for doc, text in want:
            n, now = len(text), text
            for at, removed, inserted in ((n // 3, 0, " (edited) "), (n // 2, 40, text[:30]), (int(n * 0.9), 25, "")):
                now = now[:at] + inserted + now[at + removed :]
            after.append((doc, now))
        want = after
        rows = trees.collect()
        count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert Counter((r.doc_id, r.text, r.n_tokens) for r in rows) == Counter((d, t, count(t)) for d, t in want)
        assert all(sum(r.segment_tokens) == r.n_tokens and sum(r.segment_chars) == len(r.text) and 0 not in r.segment_chars for r in rows)
    none = F.lit(None).cast(edits.EDIT)
    assert sorted(map(str, edits.edited_trees(trees, none, path).collect())) == sorted(map(str, trees.collect()))


def test_messages_of_null_ids_are_formatted(spark):
    rows = [(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0), (7, None, None, "user", "c", 0.0), (8, 1, None, "user", None, None)]
    messages = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    parts = {r.tree_id: r for r in chat.format_paths(messages).collect()}
    assert set(parts) == {NULL_ID, 7, 8}
    first = parts[NULL_ID]
    assert [first.body[s.start : s.start + s.size] for s in first.loss] == ["b"]


def test_smaller_similarities_are_refused(docs_of):
    docs = docs_of([(1, "one two three four five six", "en", "a")])
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, 0.5)
    assert neardup.near_duplicates(docs, 0.9).count() == 1


def _fold(parts, seed=42):
    for part in parts:
        seed = xxhash.xxh64_intdigest(part, seed=seed)
    return seed


def _long(value):
    return struct.pack("<Q", value & (1 << 64) - 1)


def plain_signature(text, size=64):
    """The signature with lists and loops: k-mers, their occurrences, the ring, and the next two from each point."""
    words = [_fold([w.encode()]) for w in re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text)]
    kmers = [_fold(map(_long, words[k : k + 3])) for k in range(len(words) - 2)] if len(words) >= 3 else [_fold(map(_long, words))] if words else []
    if not kmers:
        return [0] * size
    seen, ring = defaultdict(int), []
    for place, h in enumerate(kmers):
        short = h & (1 << 40) - 1
        signed = short - (1 << 40) if short >> 39 else short
        ring.append((_fold([_long(signed), struct.pack("<i", seen[short])]) >> 25, place))
        seen[short] += 1
    ring.sort()
    out = []
    for b in range(size):
        i = next((i for i, (h, place) in enumerate(ring) if (h << 24 | place) >= b << 57), 0)
        pair = sorted([ring[i], ring[(i + 1) % len(ring)]], key=lambda x: x[1])
        out.append(_fold(_long(h) for h, _ in pair) & 0xFFFFFFFF)
    return out


def test_signatures_match_a_plain_version(spark, hard):
    texts = sorted({t for _, t, *_ in hard if t is not None}) + ["one", "one two", "a b c", "a b c a b c a b c a b c", "x y " * 200]
    rows = fingerprint.signature(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "sig").collect()
    for r in rows:
        assert list(r.sig) == plain_signature(r.text), r.text[:60]
