"""Token files, packing and mixing over hard rows, against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from voxtally.llm import mixing, packing, token_files  # noqa: E402
from voxtally.llm.shared import new_path  # noqa: E402


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_every_document_in_order(spark, docs_of, hard):
    path = new_path(spark, "files")
    token_files.write_tokens(docs_of(hard), public_tokenizers.path(token_files.TOKENIZER), path, block=64, frame_tokens=500)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    order = sorted(hard, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for doc, text, *_ in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files_of_no_documents(spark, docs_of):
    path = new_path(spark, "files")
    token_files.write_tokens(docs_of([]), public_tokenizers.path(token_files.TOKENIZER), path)
    assert token_files.read_tokens(spark, path).collect() == []


def check_packing(rows, docs, size):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for doc, text, *_ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        many = -(-len(ids) // size)
        first = len(ids) - size * (many - 1)
        ends = [first + size * k for k in range(many)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            want[(doc, piece, a, b - a, crc(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_places_every_piece(docs_of, hard, size):
    rows = packing.pack(docs_of(hard), public_tokenizers.path(packing.TOKENIZER), size).collect()
    used = check_packing(rows, hard, size)
    assert used <= 1.3 * sum(r.length for r in rows) / size + 1


def test_packing_no_documents(docs_of):
    assert packing.pack(docs_of([]), public_tokenizers.path(packing.TOKENIZER)).collect() == []


def best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, free in enumerate(bins) if free >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(size - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(20))
def test_plan_over_counts_is_best_fit_over_pieces(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, 200) if seed % 2 else rng.choice([1, 2, size // 2, size // 3 + 1, size], 300)
    lengths = [max(1, int(n)) for n in lengths]
    histogram = Counter(lengths)
    used, fill = set(), Counter()
    for length, start, stop, first, fit, base in packing.plan_slots(histogram, size):
        for rank in range(start, stop):
            used.add(first + (rank - start) // fit)
            fill[first + (rank - start) // fit] += length
        histogram[length] -= stop - start
    assert not any(histogram.values()) and max(fill.values()) <= size
    assert len(used) == best_fit(lengths, size)


def test_mix_hits_targets_and_keeps_columns(docs_of):
    docs = docs_of([(k, "w " * (1 + k % 7), "en", s) for k, s in enumerate(["a"] * 2000 + ["b"] * 100 + ["c"] * 900 + [None] * 300)] + [(9999, None, None, "empty")])
    rows = mixing.mixed(docs).collect()
    per = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert r.copies * r.size <= 2 * r.size
        per[r.source][0] += r.copies * r.size
        per[r.source][1] = r.target
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, t in per.values()) - 1.5 * total) < 1e-6
    for source, (taken, target) in per.items():
        assert abs(taken - target) <= 0.01 * target + 7, source
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix_of_rows_without_ids(docs_of):
    """Rows of one id draw by their texts too, and half of a step's words is all that a source may miss."""
    rows = [(None, f"word{k} " * (1 + k % 5), "en", "a") for k in range(1500)] + [(7, f"word{k}", "en", "b") for k in range(400)] + [(k, "x y z", "en", "c") for k in range(1200)]
    got = mixing.mixed(docs_of(rows)).select("source", "size", "step", "copies", "target").collect()
    taken, target, steps = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        steps[r.source, r.step] += r.size
    for source, want in target.items():
        assert abs(taken[source] - want) <= max(n for (s, _), n in steps.items() if s == source) / 2, source
    assert all({r.copies for r in got if r.source == s and r.step == t} == {c} for s, t, c in {(r.source, r.step, r.copies) for r in got})


def test_mix_of_hard_and_no_rows(docs_of, hard):
    assert mixing.mixed(docs_of(hard)).count() == len(hard)
    assert mixing.mix(docs_of([])).collect() == []
    assert mixing.mix(docs_of([(1, None, None, None), (2, "", "x", "s")])).collect() == []
