"""Ranked search, URL filter and structure repair against plain versions."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxtally.llm import lexical, repair, urls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def plain_search(docs, queries, listed):
    counted = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    counted = [(d, c) for d, c in counted if c]
    number, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for query, text in queries:
        scores = []
        for doc_id, c in counted:
            m = 50 + 50 * c.total() * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(query, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:listed], 1)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("shelf, first", [(400_000, 4), (30, 1), (1, 2)])
def test_search_matches_a_plain_version(spark, docs_of, hard, monkeypatch, shelf, first):
    monkeypatch.setattr(lexical, "SHELF_POSTINGS", shelf)
    monkeypatch.setattr(lexical, "FIRST_SHELVES", first)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(100 + k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.choice([1, 5, 5, 60]))), "en", "a") for k in range(60)]
    rows = hard + rows + rows[:3]
    queries = [(0, "The QUICK w1 w2 w3"), (1, "w39 w30 façade 漢字"), (2, ""), (3, None), (4, "w1"), (5, "absent"), (6, "alpha0 w1 w1 x-ray w17 w20")]
    docs = docs_of(rows)
    index = lexical.build(docs)
    got = lexical.search(index, spark.createDataFrame(queries, "query long, text string"), listed=7)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain_search([(r[0], r[1]) for r in rows], queries, 7)


def test_search_of_nothing(spark, docs_of):
    none = lexical.build(docs_of([(1, None, "en", "a"), (2, " \n.", "en", "a")]))
    queries = spark.createDataFrame([(0, "a b")], "query long, text string")
    assert none.documents == 0 and lexical.search(none, queries).isEmpty()
    some = lexical.build(docs_of([(1, "a", "en", "a")]))
    assert lexical.search(some, queries.where("false")).isEmpty()
    # one document holds the term, and the weight of a term that all documents hold is floor(1000 ln(4/3))
    assert [tuple(r) for r in lexical.search(some, queries).collect()] == [(0, 1, 1, 287 * (1000000000 // 3000))]


def test_equal_scores_go_by_doc_id_beyond_the_list(spark, docs_of):
    docs = docs_of([(k, "same words here", "en", "a") for k in range(30)] + [(None, "same words here", "en", "a"), (99, "other", "en", "a")])
    got = lexical.search(lexical.build(docs), spark.createDataFrame([(0, "same words")], "query long, text string"), listed=31).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [*range(30), None]


URLS = [
    "http://Ex.ORG/", "https://example.org/es/1", "https://a.example.org/es", "https://example.org/en/1?x=1", "https://example.org/en/19#f", "https://example.org/en/2",
    "http://x.com/fr/", "http://com/de/7", "http://notcom/de/", "http://examplexorg/es/", "no scheme", None, "", "http://", "ftp://org?q=/es/", "://ORG/a//b", "http://org", "a://b://c/d?e#f",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(CAPITALS), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules_match_a_plain_version(spark):
    rows = spark.createDataFrame([(k, u, "z", 1) for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, label int")
    got = urls.judge(rows, urls.RULES).select("row.url", "row.host", F.col("host").alias("h"), "path", "rule", "score", "verdict").collect()
    assert len(got) == len(URLS) + 3
    for url, own_host, host, path, rule, score, verdict in got:
        assert own_host == "z" and (host, path) == plain_parts(url) and rule == plain_rule(url)[0] and 0 <= score <= 1
        assert verdict == (plain_rule(url)[1] or ("block" if score >= 0.5 else "allow"))
    assert urls.judge(rows.where("false"), urls.RULES).isEmpty()
    assert {r.verdict for r in urls.judge(rows, []).collect()} == {"allow"}


def test_features_match_plain_ones(spark):
    texts = ["http://a.b.example.org/x/yy/3?p=1&q=2;r#s", "aab", "http://h/" + "ab" * 4000 + "?", None]
    got = urls.lexical(urls.with_parts(spark.createDataFrame([(u,) for u in texts], "url string"))).collect()
    for r in got:
        url = r.url or ""
        counts, n = Counter(url), len(url)
        assert r.chars == n and r.entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in counts.values()), abs=1e-9)
        assert r.digits == pytest.approx(sum(c.isdigit() for c in url) / max(n, 1))
    assert (got[0].labels, got[0].depth, got[0].parameters, got[0].suffix_1, got[0].suffix_2) == (4, 3, 3, "org", "example.org")


def test_trees_learn_planted_labels_and_compile(spark):
    rng = random.Random(5)

    def one(bad):
        host = f"{'x' * rng.randint(1, 9)}{rng.randint(0, 10**6 if bad else 3)}.{rng.choice(['aa.net', 'bb.com', 'cc.biz'] if bad else ['aa.net', 'bb.com'])}"
        return f"http://{host}/{'/'.join('d' * rng.randint(1, 5) for _ in range(rng.randint(1, 3)))}" + ("?" + "&".join(f"k{j}={rng.randint(0, 10**8)}" for j in range(rng.randint(1, 5))) if bad else "")

    labelled = [(one(k % 3 == 0), float(k % 3 == 0)) for k in range(600)]
    learn = spark.createDataFrame(labelled, "url string, label double")
    fresh = [(k, one(k % 2 == 0)) for k in range(200)]
    got = urls.judge(spark.createDataFrame(fresh, "page_id long, url string"), [], learn).select("row.page_id", "verdict").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) >= 190


def plain_repair(rows):
    """Cheapest and least edits of (role, text) rows by search over (cost, audit) in order."""
    seen, faults = set(), []
    for role, text in rows:
        own = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not own else "d" if (role, text) in seen else "t" if own[-1] not in ".!?" else "-"
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, said = heapq.heappop(heap)
        letters = "".join(r[:1] or "-" for r, _ in said)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", letters):
            return faults, cost, audit, "\n".join(f"{r}:{t}" for r, t in said)
        state = (at, letters[-1:], letters[:1] == "s", len(letters) > 1, audit)
        if state in done or not any(re.fullmatch("(s?(ua)+)?", letters + tail) for tail in ("", "a", "ua")):
            continue
        done.add(state)
        if len(said) <= 2 * len(rows) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, (*said, (role, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said))
            if faults[at] not in "bd":
                more = faults[at] == "t"
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*said, rows[at])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, (*said, (role, rows[at][1]))))
    raise AssertionError


def hurt(conv, turn, role, text):
    role, text = role if role is not None else " ", text if text is not None else " "
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_row(conv, rows):
    hurts = [h for r in rows for h in hurt(conv, *r)]
    hurts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: repair.HEAD], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in hurts if t is not None]
    faults, cost, audit, text = plain_repair([(r, t) for _, r, t in hurts])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(hurts))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations_of(rng):
    texts = ["Yes.", "No!", "cut off", "", " \t", "why?", "end. \n", "é", None]
    roles = ["user", "assistant", "system", "tool", "", "User", "uncle", None]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    for conv in [None, *range(60)]:
        size = rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 7])
        turns = [rng.choice([k, k, k, k, max(k - 1, 0), None]) for k in range(size)]
        yield conv, [(t, rng.choices(roles, weights)[0], rng.choices(texts, [4, 4, 2, 1, 1, 3, 1, 1, 1])[0]) for t in turns]


@pytest.mark.parametrize("block_rows", [1, 3, 512])
def test_repair_matches_a_search_over_all_edits(spark, block_rows):
    given = [(conv, rows) for conv, rows in conversations_of(random.Random(8)) if rows]
    rows = spark.createDataFrame([(conv, *r, 1, "x") for conv, rs in given for r in rs], "conv_id long, turn long, role string, text string, pos int, fault string")
    got = repair.audit_conversations(rows, repair.damaged(rows), block_rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_row(c, rs) for c, rs in given), key=key)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert repair.audit_conversations(rows.where("false"), rows.where("false")).isEmpty()
    got = repair.audit_conversations(rows, rows.where("false")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_conversation_spreads_and_agrees_with_one_block(spark):
    rng = random.Random(4)
    said = [(7, None if k % 3 else k, rng.choice(["user", "assistant", "tool"]), f"text {rng.randint(0, 2500)}.") for k in range(5000)]
    rows = spark.createDataFrame([*said, *[(8, 0, "user", "same.")] * 3000], "conv_id long, turn long, role string, text string").repartition(8)
    few = repair.audit_conversations(rows, rows, 64)
    whole = repair.audit_conversations(rows, rows, 10_000)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))
    longest = repair.blocks_of(repair.with_faults(repair.numbered(rows)), 64).selectExpr("max(char_length(initials))").first()[0]
    assert longest == 64


def test_survivors_emit_what_they_share_and_hold_little():
    search, out = repair.Survivors(repair.START), []
    for k in range(10_000):
        out += search.step(repair.moves("ua"[k % 2], "-"))
        held, nodes = set(), [n for _, n in search.leaves.values()]
        while nodes:
            node = nodes.pop()
            if node is not search.root and id(node) not in held:
                held.add(id(node))
                nodes.append(node.parent)
        assert len(held) < 12
    cost, last, rest = search.finish({repair.ANSWERED: 0, repair.START: 0})
    assert cost == 0 and last == repair.ANSWERED and "".join(label for _, label in out + rest) == "K" * 10_000
