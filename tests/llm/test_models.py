"""Quality rules, language profiles, chat trees, edits and the pipeline."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__ as driver  # noqa: E402
import corpus_pipeline  # noqa: E402
from voxtally.llm import chat, edits, langid, quality  # noqa: E402
from voxtally.llm.registry import ORACLES, QUERIES  # noqa: E402
from voxtally.llm.tokens import word_tokenizer  # noqa: E402


def test_everything_is_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = sorted(c[0] for c in want.description)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


def remainder(doc, folds):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % folds


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = QUERIES["op2_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in held} == {d for d in truth if remainder(d, 4) == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_language_of_hard_rows(docs_of, hard):
    rows = langid.identify(docs_of(hard)).collect()
    assert len(rows) == len(hard)
    for r, (_, text, *_rest) in zip(rows, hard):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    assert langid.identify(docs_of([])).collect() == []
    assert {r.lang_pred for r in langid.identify(docs_of([(1, "words", None, None)])).collect()} == {"und"}
    docs = docs_of(hard)
    kept = langid.keep_known(docs)
    known = [text for r, (_, text, *_rest) in zip(rows, hard) if r.lang_pred != "und"]
    assert kept.columns == docs.columns and Counter(r.text for r in kept.collect()) == Counter(known)


def test_known_rows_are_those_op2_names(docs_of):
    rng = np.random.default_rng(5)
    learned = [(k, "the quick brown fox jumps over the lazy dog and runs home", "en", "a") for k in range(20)]
    learned += [(20 + k, "der schnelle braune fuchs springt und rennt nach hause", "de", "a") for k in range(20)]
    short = [(100 + k, word, None, "b") for k, word in enumerate("fox lazy runs haus und brunch zebra it".split())]
    scripts = [(200 + k, " ".join("".join(map(chr, rng.integers(low, low + 24, 6))) for _ in range(20)), None, "c") for k, low in enumerate([0x3B1, 0x430, 0x4E00] * 20)]
    none = [(300, "12 !? 7", None, "c"), (301, "", None, "c"), (302, None, None, "c")]
    docs = docs_of(learned + short + scripts + none)
    kept = Counter(r.doc_id for r in langid.keep_known(docs).collect())
    assert kept == Counter(r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und") == Counter(row[0] for row in learned + short + scripts)


def test_bundles_match_a_plain_version():
    b = langid.Bundler(64)
    texts = ["Hé, llo 12 wörld", "hello world", "", "a", "漢字 漢", "aaa aaa aaa", "one two three"]
    for row, text in zip(b.bundle([t.lower() for t in texts]), texts):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        spaced = f" {' '.join(words)} " if words else ""
        want = np.zeros(64)
        for k in range(len(spaced) - 2):
            # a letter is turned by its place, the boundary's own vector is not
            x = [np.roll(b._vector(ord(c)), 2 - place) if c != " " else b._vector(0) for place, c in enumerate(spaced[k : k + 3])]
            want += x[0].astype(int) * x[1] * x[2]
        assert np.array_equal(row, want), (text, row[:8], want[:8])
    assert not np.array_equal(*b.bundle(["abc", "cba"])), "the order of letters counts"


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = QUERIES["op1_quality_rules"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    right = np.array([r.predicted == truth[r.doc_id] for r in held])
    bad = np.array([truth[r.doc_id] == 0 for r in held])
    assert right.mean() > 0.95 and right[bad].mean() > 0.8


def test_quality_without_labels_and_of_hard_rows(spark, docs_of, hard):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs_of(hard), none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1, 0) for k in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs_of(hard), one).collect()} == {1.0}
    assert quality.score_quality(docs_of([]), none).collect() == []


def test_rules_become_columns(spark):
    rule = (("a", True, 1.0), ("b", False, 2.0))
    df = spark.createDataFrame([(0.0, 3.0), (2.0, 3.0), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(quality.compiled(-1.0, [(2.0, rule)])).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-1)), 1 / (1 + np.exp(1)), 1 / (1 + np.exp(1))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "<", "[", "\\", "|", "\n", "<|im_end\\|>"]), st.text(max_size=3)), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    assert chat.parse_turns(chat.format_turn(text, text)[0] * 2) == [(text, text)] * 2


def test_conversations_of_hard_rows(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"turn {k} </s>" * (k % 3)) for k in range(700)]  # many parts and blocks
    rows += [(None, 1, "user", "a"), (None, 0, None, None), (3, None, "assistant", "b"), (3, None, "assistant", "b"), (3, 5, "assistant", None), (4, 2**60, "x\ny\\", "<|im_end|>\n")]
    rng.shuffle(rows)
    got = {r.conv_id: r for r in chat.formatted_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node_id int")).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, own in groups.items():
        own.sort()
        loss = "".join(t for *_, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(empty).collect() == []


def test_paths_of_branching_trees(spark):
    rng = random.Random(9)
    rows, want = [], []
    for tree in range(30):
        score, parent = {}, {}
        for node in range(rng.randrange(1, 40)):
            parent[node] = rng.randrange(node) if node else None
            score[node] = rng.choice([None, 0.0, 1.0, 2.5, -1.0])
            rows.append((tree, node, parent[node], score[node]))
        ranked = []
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            ranked.append((-sum(score[n] or 0 for n in path) / len(path), -len(path), leaf, path[::-1]))
        for *_, leaf, path in sorted(ranked)[:2]:
            want += [(tree, leaf, k, n) for k, n in enumerate(path)]
    rows += [(50, 1, 2, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0), (51, 1, 99, 0.0)]  # a circle; a parent that isn't there
    want.append((51, 1, 0, 1))
    messages = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double")
    assert sorted(tuple(r) for r in chat.leaf_paths(messages, keep=2).collect()) == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_edits_count_like_a_new_encoding(data):
    words = word_tokenizer(public_tokenizers.path(edits.TOKENIZER))
    count = lambda t: len(words.tokenizer.encode(t, add_special_tokens=False).ids)
    part = st.sampled_from(["a", "the", " ", " ", "\n", "  ", "é", "<|endoftext|>", "'s", "12", "!", "\t", "漢", "word "])
    text = data.draw(st.lists(part, max_size=60).map("".join))
    pieces = edits.segments(text, data.draw(st.integers(1, 30)))
    tree = edits.SegmentTree(pieces, [count(p) for p in pieces])
    assert "".join(pieces) == text and tree.tokens[1] == count(text)
    for _ in range(data.draw(st.integers(0, 4))):
        at, removed, inserted = data.draw(st.integers(-2, 90)), data.draw(st.sampled_from([0, 1, 4, 30])), data.draw(st.lists(part, max_size=4).map("".join))
        start = min(max(at, 0), len(text))
        text = text[:start] + inserted + text[min(start + removed, len(text)) :]
        tree.edit(at, removed, inserted)
        for leaf in tree.settle():
            tree._set(tree.tokens, leaf, count(tree.pieces[leaf]))
        assert "".join(tree.pieces) == text and tree.tokens[1] == count(text)


def test_edit_query_against_new_encodings(spark, docs_of, hard):
    path = public_tokenizers.path(edits.TOKENIZER)
    words = word_tokenizer(path)
    docs = docs_of(hard)
    trees = edits.build_trees(docs, path)
    rows = edits.apply_edits(trees, edits.sample_edits(), path).collect()
    want = Counter()
    for doc, text, *_ in hard:
        text = text or ""
        n, before = len(text), len(words.tokenizer.encode(text, add_special_tokens=False).ids)
        after = text
        for at, removed, inserted in ((n // 3, 0, " (edited) "), (n // 2, 40, text[:30]), (int(n * 0.9), 25, "")):
            after = after[:at] + inserted + after[at + removed :]
        want[(doc, before, len(after), len(words.tokenizer.encode(after, add_special_tokens=False).ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.edited_chars, r.edited_tokens) for r in rows) == want
    assert max(r.edited_chars for r in rows) > 10 * max(r.encoded_chars for r in rows if r.edited_chars > 20_000)
    assert edits.apply_edits(edits.build_trees(docs_of([]), path), edits.sample_edits(), path).collect() == []


def test_pipeline_stages_are_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] and counts[1] > 0.97 * counts[0]
    texts = [r.text for r in docs.collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    tokenizer = word_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    assert sum(r.length for r in packed) == sum(len(e.ids) + 1 for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_of_hard_rows(spark, docs_of, hard):
    for rows in (hard, []):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
        assert (docs.count() > 0) == bool(rows)


def test_words_encode_takes_no_texts():
    ids, offsets = word_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]
