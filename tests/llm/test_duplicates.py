"""Exact and near duplicates, and fingerprints, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxtally.llm import exact, fingerprint, neardup
from voxtally.llm.graph import components


def want_exact(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    return Counter((doc, min(own)[3], len(own), hashlib.sha256(key.encode()).hexdigest()) for key, own in groups.items() for *_, doc in own)


@pytest.mark.parametrize("page_keys,key_bits", [(4096, 63), (2, 63), (1, 3)])
def test_exact_groups(docs_of, hard, page_keys, key_bits):
    """Small pages split the directory; three bits of hash make chains of different texts."""
    rows = hard + [(100 + k, f"text {k % 20}", None, None) for k in range(60)]
    got = exact.exact_groups(docs_of(rows), page_keys, key_bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want_exact(rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256 for r in got})


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).selectExpr("shiftrightunsigned(xxhash64(id), 1) AS h")
    slots = exact.directory(keys, 200).collect()
    assert {r.depth for r in slots} <= set(range(4, 8)) and len({(r.bucket, r.depth) for r in slots}) > 16


def test_drop_copies_keeps_columns(docs_of, hard):
    docs = docs_of(hard)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({sha for *_, sha in want_exact(hard)})
    assert exact.drop_copies(docs_of([])).collect() == []


def bag(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def jaccard(a, b):
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 1.0


def want_classes(texts):
    bags = [bag(t) for t in texts]
    top = list(range(len(texts)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def varied():
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(3000))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    # a chain, whose ends are no near copies of each other
    chain = [word() for _ in range(200)]
    for k in range(8):
        texts.append(" ".join(chain[k * 12 : k * 12 + 110]))
    return texts + ["", None, " ", "a b", "A  b", "to " * 50, "to " * 55, "to " * 80]


def test_near_duplicates_are_the_components_of_all_links(docs_of, varied):
    rows = [(k, t, None, None) for k, t in enumerate(varied)]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(rows)).collect()}
    want = want_classes(varied)
    assert [got[k].class_id for k in range(len(varied))] == want
    assert all(got[k].kept == (want[k] == k) for k in got)
    docs = docs_of(rows)
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_near_duplicates_of_hard_and_no_rows(docs_of, hard):
    got = neardup.near_duplicates(docs_of(hard)).collect()
    assert len(got) == len(hard) and sum(r.kept for r in got) == len(set(want_classes([r[1] for r in hard])))
    assert neardup.near_duplicates(docs_of([])).collect() == []


def test_signatures_are_unbiased():
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        a = Counter({f"w{k}": rng.choice([1, 1, 2, 3, 9, 40]) for k in range(40)})
        b = Counter({w: n if rng.random() < 0.6 else rng.choice([1, 5, 20]) for w, n in a.items() if rng.random() < 0.9})
        texts += [a, b]
    owner = np.concatenate([np.full(len(c), k) for k, c in enumerate(texts)])
    names = sorted({w for c in texts for w in c})
    numbers = dict(zip(names, neardup.mix64(np.arange(1, len(names) + 1, dtype=np.uint64))))
    shingle = np.array([numbers[w] for c in texts for w in c], np.uint64)
    weight = np.array([n for c in texts for n in c.values()])
    signs = neardup.bag_minhash(owner, shingle, weight, len(texts), 256)
    errors = [np.mean(signs[2 * k] == signs[2 * k + 1]) - jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(60)]
    assert abs(np.mean(errors)) < 0.012 and np.max(np.abs(errors)) < 0.15


def test_shingles_match_plain_counts(hard, varied):
    texts = [r[1] for r in hard] + varied
    owner, _, weight = neardup.shingles(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert sorted(weight[owner == k].tolist()) == sorted(bag(text).values()), text


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (100, 95), (7, 7), (300, 200), (200, 300)]
    got = {r.node: r.top for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 95: 90, 90: 90, 300: 200, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_signature(spark, texts):
    df = fingerprint.signature(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), "text", "sig")
    return {r.k: r.sig for r in df.collect()}


def test_signature_follows_order_and_content(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(400)]
    text = " ".join(words)
    edited = " ".join(words[:390] + ["other"] * 10)
    halves = " ".join(words[200:] + words[:200])
    shuffled = words[:]
    rng.shuffle(shuffled)
    got = plain_signature(spark, [text, text, edited, halves, " ".join(shuffled), "", "one", "one", "la " * 50, "la " * 60, "x" * 500])
    near = lambda a, b: np.mean(np.array(got[a]) == np.array(got[b]))
    assert near(0, 1) == 1 and near(6, 7) == 1 and near(5, 0) == 0
    assert near(0, 2) > 0.7 and near(0, 4) < 0.05
    assert 0.2 < near(0, 3) < 0.8  # same k-mers, but pairs across the halves change their order
    assert near(8, 9) > 0.3 and len(set(got[10])) > 1


def want_edits(rows):
    ids = sorted({-(2**63) if d is None else d for d, *_ in rows}, reverse=True)
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[-(2**63) if d is None else d].append(t or "")
    return Counter((d, len(t or ""), hashlib.sha256(edit(t or "", texts[following[-(2**63) if d is None else d]]).encode()).hexdigest()) for d, t, *_ in rows)


def edit(text, others):
    cut = len(text) // 3
    return text[: len(text) - cut] + min(others)[:cut]


def test_fingerprints_of_hard_rows(docs_of, hard):
    rows = [r for r in hard if r[0] != 8 or r[1].startswith("the")]  # which text of a repeated id comes next is another test's matter
    got = fingerprint.fingerprints(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want_edits(rows)
    for r in got:
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * fingerprint.SIGNATURE and 0 <= r.near_edited <= 1
    assert fingerprint.fingerprints(docs_of([])).collect() == []


def test_fingerprints_follow_ids_across_ranges(spark, docs_of):
    rows = [(k * 7 % 501, f"text number {k} " * (k % 5 + 1), None, None) for k in range(501)]
    got = fingerprint.fingerprints(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want_edits(rows)
