"""Chat formatting of reply trees.

Iterative self-joins double the reach of every message towards its root, so a path of n messages takes log2(n) rounds. Leaves are ranked by
the mean score of their path, the chosen paths are spelled out by the same joins, and each becomes one conversation in a template whose
control strings can't occur in a text. A conversation is written in parts of bounded numbers of turns; loss masks are spans of a part.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.shared import NULL_ID, id_key, new_path, stored, text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other common templates; none of them stays whole inside a text.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
PART_TURNS = 64
ORDER_TURNS = 256
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_WHOLE = re.compile(rf"([<\[])(\\*)({_TAILS})")
_BROKEN = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)
PART_SCHEMA = "tree_id long, path long, part long, body string, loss array<struct<start:long,size:long>>"


def escape(text: str) -> str:
    """A backslash behind the first character of every control string; one more where there are some already."""
    return _WHOLE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text starts and ends in it."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turns(body: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part; anything outside a turn raises ValueError."""
    turns, at = [], 0
    for m in _TURN.finditer(body):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(body):
        raise ValueError("not a formatted conversation")
    return turns


def leaf_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree_id, path, position, node_id of the ``keep`` best root-to-leaf paths of each tree, from (tree_id, node_id, parent_id, score).

    A path is named by its leaf. Paths rank by mean score (null scores count as 0), longer ones first on ties, then the smallest leaf. A
    parent that isn't there makes a root; messages on or below a circle of parents belong to no path.
    """
    nodes = messages.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    there = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("node_id").alias("up"))
    now = stored(nodes.join(there, ["tree_id", "parent_id"], "left").select("tree_id", "node_id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "reach")
    roof = max(now.count(), 1).bit_length() + 1
    jumps = []
    while len(jumps) < roof:
        active = now.where("up IS NOT NULL")
        if active.isEmpty():
            break
        jumps.append(active.select("tree_id", "node_id", "up"))
        above = now.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        reached = active.join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        now = stored(reached.unionByName(now.where("up IS NULL")), "reach")
    parents = (jumps[0] if jumps else now.where("false")).select("tree_id", F.col("up").alias("node_id")).distinct()
    leaves = now.where("up IS NULL").join(parents, ["tree_id", "node_id"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy((F.col("total") / F.col("depth")).desc(), F.desc("depth"), "node_id")
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    paths = stored(chosen.select("tree_id", F.col("node_id").alias("path"), "depth", "node_id", F.lit(0).cast("long").alias("back")), "paths")
    for level in reversed(range(len(jumps))):
        further = paths.join(jumps[level], ["tree_id", "node_id"]).select("tree_id", "path", "depth", F.col("up").alias("node_id"), (F.col("back") + (1 << level)).alias("back"))
        paths = stored(paths.unionByName(further), "paths")
    return paths.select("tree_id", "path", (F.col("depth") - 1 - F.col("back")).alias("position"), "node_id")


def format_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Parts (tree_id, path, part, body, loss) of the chosen paths; ``loss`` spans the assistant's texts in ``body``.

    Null roles and texts are empty; a null tree_id or node_id is an id of its own, the smallest one, and a null parent_id makes a root. A part
    gathers PART_TURNS turns at most, however long a path is.
    """
    messages = messages.withColumns({c: id_key(c) for c in ("tree_id", "node_id")})
    placed = leaf_paths(messages, keep).join(messages.select("tree_id", "node_id", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text")), ["tree_id", "node_id"])
    turns = F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns")
    parts = placed.groupBy("tree_id", "path", F.floor(F.col("position") / PART_TURNS).alias("part")).agg(turns)

    def write(batches):
        for batch in batches:
            bodies, spans = [], []
            for turns in batch.column(3).to_pylist():
                body, own, at = [], [], 0
                for turn in turns:
                    shown, start, end = format_turn(turn["role"], turn["text"])
                    if turn["role"] == LEARNED_ROLE:
                        own.append({"start": at + start, "size": end - start})
                    body.append(shown)
                    at += len(shown)
                bodies.append("".join(body))
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.string()), pa.array(spans, kind)], names=["tree_id", "path", "part", "body", "loss"])

    return parts.mapInArrow(write, PART_SCHEMA)


def digest(parts: DataFrame) -> DataFrame:
    """tree_id, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted parts.

    A conversation's parts stream through one task in order; only running hashes are held.
    """

    def read(batches):
        key, state = None, None

        def close():
            turns, loss, n, chars, shown = state
            return (*key, n, turns.hexdigest(), chars, loss.hexdigest(), shown)

        for batch in batches:
            done = []
            for tree, path, body, spans in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if (tree, path) != key:
                    if key is not None:
                        done.append(close())
                    key, state = (tree, path), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in parse_turns(body):
                    state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[2] += 1
                for span in spans:
                    text = unescape(body[span["start"] : span["start"] + span["size"]])
                    state[1].update(text.encode("utf-8", "surrogatepass"))
                    state[3] += len(text)
                state[4] += len(body)
            if done:
                yield _digests(done)
        if key is not None:
            yield _digests([close()])

    ordered = parts.repartition("tree_id", "path").sortWithinPartitions("tree_id", "path", "part")
    return ordered.mapInArrow(read, "tree_id long, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["tree_id", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def as_trees(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each row replies to the one before it, by turn (null first), then role and text.

    Rows are ordered inside blocks of turns and counted over blocks, so that a conversation of very many rows is no single group.
    """
    rows = conversations.select(id_key("conv_id").alias("tree_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / ORDER_TURNS), F.lit(NULL_ID)))
    inside = F.row_number().over(Window.partitionBy("tree_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    blocks = rows.groupBy("tree_id", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("tree_id", "block", (F.sum("n").over(Window.partitionBy("tree_id").orderBy("block")) - F.col("n")).alias("before"))
    placed = rows.withColumn("inside", inside).join(blocks, ["tree_id", "block"]).withColumn("node_id", F.col("before") + F.col("inside"))
    return placed.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and digests of every conversation, each formatted, written to the shared folder and read back.

    A null conv_id is one conversation; repeated rows are turns of their own; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    path = new_path(spark, "formatted")
    format_paths(stored(as_trees(conversations), "messages")).write.parquet(path)
    read = digest(spark.read.schema(PART_SCHEMA).parquet(path))
    return read.select(F.when(F.col("tree_id") != F.lit(NULL_ID), F.col("tree_id")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, LEARNED_ROLE, "</s>[INST] ok [/INST]")]
    return formatted_conversations(rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")))


OP3_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS shown FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown) + length(role) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
