"""Conversation structure repair by a Viterbi search with survivor coalescence.

Rows of a conversation are numbered by a range exchange, so one of very many rows spreads over tasks, and dealt into blocks. A block's search
starts from each of the four states and leaves the cheapest edits from every state to every other; a second search of the same kind chooses
states at block edges. Survivors hang in a tree of backpointers that count their children: branches without a survivor are dropped, and what
all survivors share is emitted at once. Ties compare what two survivors do not share, from their last common node on.

Every row has one token: inserts before it, then Keep, Rerole or Delete. No token starts another, so texts of equally many tokens compare as
their first different token does, and a tie inside a block stays decided whatever follows.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.shared import NULL_ID, id_key, new_path, stored

BLOCK_ROWS = 512
#: Characters of a text that order rows of one turn and role; its SHA-256 orders the rest.
HEAD = 256
BLANK = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
RETURNED = ("user", "assistant")
#: States: nothing yet, system only, user last, assistant last. A conversation may end in START or ANSWERED.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: Where an inserted or reroled turn leads: it is the assistant's after the user's, else the user's.
_NEXT = {START: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
_KEPT = {("s", START): SYSTEM, ("u", START): ASKED, ("u", SYSTEM): ASKED, ("u", ANSWERED): ASKED, ("a", ASKED): ANSWERED}
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
_CLOSING = {START: 0, SYSTEM: 2, ASKED: 1, ANSWERED: 0}
#: What it costs at most to go on from the first state as a path may from the second: deleting the system row that only a start can keep (3),
#: answering (2) or asking (2) by an insert, or both at the end (4). A survivor that is dearer by more can't be part of the best path.
_IMITATES = {
    (START, SYSTEM): 0, (START, ASKED): 2, (START, ANSWERED): 0, (SYSTEM, START): 4, (SYSTEM, ASKED): 2, (SYSTEM, ANSWERED): 4,
    (ASKED, START): 5, (ASKED, SYSTEM): 2, (ASKED, ANSWERED): 2, (ANSWERED, START): 3, (ANSWERED, SYSTEM): 0, (ANSWERED, ASKED): 2,
}
_LEGAL = {"su", "ua", "au"}
_TOKEN = re.compile("I*[KRD]")


class _Node:
    __slots__ = ("parent", "label", "state", "children")

    def __init__(self, parent, label, state):
        self.parent, self.label, self.state, self.children = parent, label, state, 0


class Survivors:
    """The cheapest path to every state, the least labels on ties, with all steps that are not decided yet.

    From one state a label leads to one state only, and labels of a step compare as the paths through them do.
    """

    def __init__(self, state: int):
        self.root = _Node(None, None, state)
        self.leaves = {state: (0, self.root)}

    def _less(self, a: _Node, a_label, b: _Node, b_label) -> bool:
        """Whether the path through ``a`` and then its label comes before that through ``b``: the first labels after their last common node decide."""
        while a is not b:
            a_label, b_label = a.label, b.label
            a, b = a.parent, b.parent
        return a_label < b_label

    def _drop(self, node: _Node) -> None:
        while node.children == 0 and node is not self.root:
            node = node.parent
            node.children -= 1

    def step(self, moves) -> list[tuple[int, object]]:
        """Take a step by ``moves`` (from, to, cost, label); what is now decided, as (state before, label), in order."""
        best: dict[int, tuple] = {}
        for source, target, cost, label in moves:
            if source not in self.leaves:
                continue
            total = self.leaves[source][0] + cost
            node = self.leaves[source][1]
            had = best.get(target)
            if had is None or total < had[0] or (total == had[0] and self._less(node, label, had[1], had[2])):
                best[target] = (total, node, label)
        hopeless = {t for t in best for o in best if o != t and best[t][0] > best[o][0] + _IMITATES[o, t]}
        before, self.leaves = self.leaves, {}
        for target, (total, node, label) in best.items():
            if target in hopeless:
                continue
            node.children += 1
            self.leaves[target] = (total, _Node(node, label, target))
        for _, node in before.values():
            if node.children == 0:
                self._drop(node)
        return self._decided()

    def _decided(self) -> list[tuple[int, object]]:
        if self.root.children != 1:
            return []
        path, node = [], next(iter(self.leaves.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = []
        while self.root.children == 1:
            child = path.pop()
            out.append((self.root.state, child.label))
            child.parent, self.root = None, child
        return out

    def finish(self, closing: dict[int, int]) -> tuple[int, int, list[tuple[int, object]]]:
        """Cost and last state of the best path when ending in a state costs ``closing``, and the rest of its steps."""
        chosen = None
        for state, more in closing.items():
            if state in self.leaves:
                cost, node = self.leaves[state]
                if chosen is None or cost + more < chosen[0] or (cost + more == chosen[0] and self._less(node, None, chosen[1], None)):
                    chosen = (cost + more, node)
        cost, node = chosen
        rest, last = [], node.state
        while node is not self.root:
            rest.append((node.parent.state, node.label))
            node = node.parent
        return cost, last, rest[::-1]


@functools.cache
def moves(initial: str, fault: str) -> tuple[tuple[int, int, int, str], ...]:
    """The cheapest token, the least on ties, from every state to every other, for a row of this role initial and fault (b, d, t or -)."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for source in range(4):
        state, cost, token = source, 0, ""
        for _ in range(3):  # a third insert leads where the first one did
            own = [(state, DELETE_COST, "D")]
            if fault not in "bd":
                more = TRUNCATED_COST if fault == "t" else 0
                own.append((_NEXT[state], REROLE_COST + more, "R"))
                if (initial, state) in _KEPT:
                    own.append((_KEPT[initial, state], more, "K"))
            for target, price, letter in own:
                found = (cost + price, token + letter)
                if best.get((source, target), found) >= found:
                    best[source, target] = found
            state, cost, token = _NEXT[state], cost + INSERT_COST, token + "I"
    return tuple((source, target, cost, token) for (source, target), (cost, token) in best.items())


def block_options(initials: str, faults: str) -> list[tuple[int, int, int, int, str]]:
    """(from, to, cost, rank, audit) of the cheapest way from every state to every other through a block; ranks order the audits."""
    found = []
    for source in range(4):
        search, done = Survivors(source), []
        for initial, fault in zip(initials, faults):
            done += search.step(moves(initial, fault))
        shared = "".join(label for _, label in done)
        for target in list(search.leaves):
            cost, _, rest = search.finish({target: 0})
            found.append((source, target, cost, shared + "".join(label for _, label in rest)))
    ranks = {audit: k for k, audit in enumerate(sorted({f[3] for f in found}))}
    return [(source, target, cost, ranks[audit], audit) for source, target, cost, audit in found]


def replay(state: int, audit: str, initials: str) -> list[tuple[list[str], str | None, int]]:
    """For every token: the roles inserted before its row, the role that it sets (R only), and the state after it."""
    out = []
    for token, initial in zip(_TOKEN.findall(audit), initials):
        roles = []
        for letter in token:
            if letter in "IR":
                roles.append(RETURNED[state == ASKED])
                state = _NEXT[state]
            elif letter == "K":
                state = _KEPT[initial, state]
        set_role = roles.pop() if token[-1] == "R" else None
        out.append((roles, set_role, state))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.

    Nulls of role and text, and of the ids inside the hash, are one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def _number(batches):
    """Add the exchange's partition and the row's place among those of its conversation in it."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.r_[conv[0] != last, np.diff(conv) != 0])
        place = np.arange(len(conv)) + held
        for start, end in zip(starts, [*starts[1:], len(conv)]):
            place[start:end] = np.arange(end - start)
        held, last = int(place[-1]) + 1, conv[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


def numbered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, digest, initial, pos: rows of a conversation by turn (nulls first), role, the text's head and SHA-256, from 0.

    A null conv_id is one conversation; equal rows stand beside each other in any order. Null roles and texts are one space.
    """
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    df = rows.select(id_key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), one_space("role"), one_space("text"))
    df = df.withColumns({"digest": F.sha2(F.col("text").cast("binary"), 256), "head": F.substring("text", 1, HEAD), "rid": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "head", "digest", "rid"]
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "rid")
    kinds = "conv long, turn long, role string, text string, digest string, part long, place long"
    placed = stored(spread.mapInArrow(_number, kinds), "rows")
    # one row a conversation and partition
    counts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = counts.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    letter = F.substring("role", 1, 1)
    initial = F.when(letter.isin("s", "u", "a"), letter).otherwise(F.lit("o"))
    return placed.join(before, ["conv", "part"]).select("conv", "turn", "role", "text", "digest", initial.alias("initial"), (F.col("before") + F.col("place")).alias("pos"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Slim rows conv, turn, initial, pos, fault from :func:`numbered`: b blank, d said before in the conversation, t truncated, else -."""
    slim = rows.select("conv", "turn", "initial", "pos", "role", "digest", F.regexp_like("text", F.lit(BLANK)).alias("says"), F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("end"))
    slim = stored(slim, "faults")
    first = slim.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = F.when(~F.col("says"), "b").when(F.col("first").isNull(), "d").when(~F.col("end").isin(".", "!", "?"), "t").otherwise("-")
    return slim.join(first, ["conv", "pos"], "left").select("conv", "turn", "initial", "pos", fault.alias("fault"))


def blocks_of(slim: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv, block, initials, faults: one letter a row, ``block_rows`` rows at most."""
    rows = slim.groupBy("conv", F.floor(F.col("pos") / block_rows).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("r"))
    return rows.select("conv", "block", F.array_join("r.initial", "").alias("initials"), F.array_join("r.fault", "").alias("faults"))


_OPTIONS = "conv long, block long, source int, target int, cost long, rank int, audit string"


def _search_blocks(batches):
    for batch in batches:
        rows = [(conv, block, *option) for conv, block, initials, faults in zip(*(c.to_pylist() for c in batch.columns)) for option in block_options(initials, faults)]
        names = ["conv", "block", "source", "target", "cost", "rank", "audit"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)


_CHOSEN = "conv long, block long, source int, rank int, cost long, closing int, state int"


def _choose(batches):
    """The way through every block, and a last row, of block null, with cost, inserts at the end and the state before them; blocks come in order."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in _CHOSEN.split(", ")]
    conv, search, at, out = None, None, 0, []

    def take(steps):
        nonlocal at
        for state, rank in steps:
            out.append((conv, at, state, rank, None, None, None))
            at += 1

    def close():
        cost, last, rest = search.finish({s: INSERT_COST * n for s, n in _CLOSING.items()})
        take(rest)
        out.append((conv, None, None, None, cost, _CLOSING[last], last))

    for batch in batches:
        for own, options in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if search is None or own != conv:
                if search is not None:
                    close()
                conv, search, at = own, Survivors(START), 0
            take(search.step([(o["source"], o["target"], o["cost"], o["rank"]) for o in options]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
    if search is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def cheapest_edits(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, block, source, initials, audit of every block, and conv, cost, closing, state of every conversation."""
    options = stored(blocks.select("conv", "block", "initials", "faults").mapInArrow(_search_blocks, _OPTIONS), "options")
    ways = options.groupBy("conv", "block").agg(F.collect_list(F.struct("source", "target", "cost", "rank")).alias("ways"))
    chosen = stored(ways.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_choose, _CHOSEN), "chosen")
    audits = chosen.where("block IS NOT NULL").join(options.select("conv", "block", "source", "rank", "audit"), ["conv", "block", "source", "rank"])
    pieces = audits.join(blocks.select("conv", "block", "initials"), ["conv", "block"]).select("conv", "block", "source", "initials", "audit")
    return stored(pieces, "pieces"), chosen.where("block IS NULL").select("conv", "cost", "closing", "state")


_EDITS = "conv long, pos long, inserted array<string>, set_role string, letter string"


def _row_edits(block_rows: int):
    def spell(batches):
        for batch in batches:
            out = []
            for conv, block, source, initials, audit in zip(*(c.to_pylist() for c in batch.columns)):
                letters = audit.replace("I", "")
                out += [(conv, block * block_rows + k, roles, role, letters[k]) for k, (roles, role, _) in enumerate(replay(source, audit, initials))]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=[c.split()[0] for c in _EDITS.split(", ")])

    return spell


def repaired(rows: DataFrame, pieces: DataFrame, ends: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations, conv, pos, seq, role, text, edit, in order of (pos, seq): rows with their edits done and inserted ones, whose text is empty."""
    edits = pieces.mapInArrow(_row_edits(block_rows), _EDITS)
    done = rows.join(edits, ["conv", "pos"])
    inserted = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.array(F.struct(F.coalesce("set_role", "role").alias("role"), F.col("text"), F.col("letter").alias("edit")))
    turns = done.select("conv", "pos", F.posexplode(F.concat(inserted, F.when(F.col("letter") != "D", own).otherwise(F.array().cast(_TURNS)))).alias("seq", "t"))
    said = F.transform(F.sequence(F.lit(1), "closing"), lambda k: F.struct(F.when((F.col("state") == ASKED) | (k == 2), RETURNED[1]).otherwise(RETURNED[0]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    last = ends.where("closing > 0").select("conv", F.lit(2**62).alias("pos"), F.posexplode(said).alias("seq", "t"))
    return turns.unionByName(last).select("conv", "pos", "seq", "t.role", "t.text", "t.edit")


_TURNS = "array<struct<role:string,text:string,edit:string>>"


def _hashed(batches):
    """SHA-256 of every conversation's ``role:text`` lines, which come in order; one running hash is held."""
    key, state, done = None, None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if state is None or conv != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv", "repaired_sha256"])
        done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


def audit_conversations(conversations: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The contract's row of every conv_id of ``conversations``, whose rows, after whatever was done to them, are ``rows``.

    A role without one of the initials s, u and a, the empty one too, can't be kept. A conv_id without rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows.
    """
    path = new_path(rows.sparkSession, "numbered")
    numbered(rows).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    slim = stored(with_faults(placed), "slim")
    blocks = stored(blocks_of(slim, block_rows), "blocks")
    pieces, ends = cheapest_edits(blocks)
    counts = slim.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == letter).alias(name) for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))],
    )
    # pairs inside a block, and the one that it makes with the block before
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("initials")), lambda k: F.substring(F.col("run"), k, F.lit(2)))
    edges = blocks.select("conv", "block", "initials", F.lag(F.right("initials", F.lit(1))).over(Window.partitionBy("conv").orderBy("block")).alias("left"))
    illegal = edges.withColumn("run", F.concat(F.coalesce("left", F.lit("")), "initials")).select("conv", F.size(F.filter(pairs, lambda p: (F.char_length(p) == 2) & ~p.isin(*_LEGAL))).alias("n")).groupBy("conv").agg(F.sum("n").alias("illegal"))
    audits = pieces.groupBy("conv").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("body"))
    text = repaired(placed, pieces, ends, block_rows).repartition("conv").sortWithinPartitions("conv", "pos", "seq").select("conv", "role", "text")
    hashes = text.mapInArrow(_hashed, "conv long, repaired_sha256 string")
    out = conversations.select(id_key("conv_id").alias("conv")).distinct()
    for table in (counts, illegal, ends.drop("state"), audits, hashes):
        out = out.join(table, "conv", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.concat(F.coalesce("body", F.lit("")), F.repeat(F.lit("I"), F.coalesce("closing", F.lit(0)))).alias("audit")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"), *zeros, audit, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair after the contract's damage."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return audit_conversations(conversations, damaged(conversations))


def _moves_sql() -> str:
    """Moves as rows for the twin: initial, fault, from, to, cost, token, roles inserted, role set."""
    shown = lambda roles: "[" + ", ".join(f"'{r}'" for r in roles) + "]"
    rows = []
    for initial in "suao":
        for fault in "bdt-":
            for source, target, cost, token in moves(initial, fault):
                ((roles, set_role, _),) = replay(source, token, initial)
                rows.append(f"('{initial}', '{fault}', {source}, {target}, {cost}, '{token}', {shown(roles)}::VARCHAR[], {repr(set_role) if set_role else 'NULL'})")
    return ", ".join(rows)


OP13_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(0, 256) r(n)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations),
marked AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(k, lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
damage AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE kind <> 0),
placed AS (SELECT coalesce(conv_id, {NULL_ID}) AS conv, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {HEAD}), sha256(text), copy) - 1 AS pos,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM damage),
faults AS MATERIALIZED (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY pos) AS before, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM placed),
moves AS MATERIALIZED (SELECT * FROM (VALUES {_moves_sql()}) m(initial, fault, state, target, price, token, roles, set_role)),
walk AS (SELECT DISTINCT conv, 0::BIGINT AS pos, 0 AS state, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS best FROM faults
  UNION ALL SELECT w.conv, w.pos + 1, target, min({{'cost': best.cost + price, 'audit': best.audit || token, 'said': best.said || list_transform(roles, lambda r: r || ':') || CASE WHEN token LIKE '%D' THEN [] ELSE [coalesce(set_role, role) || ':' || text] END}})
  FROM walk w JOIN faults f ON f.conv = w.conv AND f.pos = w.pos JOIN moves m ON m.initial = f.initial AND m.fault = f.fault AND m.state = w.state GROUP BY w.conv, w.pos, target),
counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1),
closed AS (SELECT conv, min({{'cost': best.cost + 2 * len(z), 'audit': best.audit || repeat('I', len(z)), 'said': best.said || z}}) AS best FROM walk JOIN counts USING (conv)
  JOIN (VALUES (0, []::VARCHAR[]), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])) e(state, z) USING (state) WHERE pos = n GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv = coalesce(o.conv_id, {NULL_ID}) LEFT JOIN closed d ON d.conv = c.conv"""
