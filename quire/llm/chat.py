"""Operator 3: chat formatting by a prefix tree.

Conversations are paths of turns.  Sorted by path, those that share first turns
are neighbours, and the sorted order is the tree's depth-first order.  Runs of
that order are packed: within a pack each shared turn is emitted once, and every
turn (node) carries the position id of its first token and the intervals of
its ancestors, which are all it may attend to besides itself.  Packs end after
PACK_CHARS, so a first turn that very many conversations share is repeated once
per pack and no task holds a whole tree.  Equal conversations are one path.

A turn is ``### role: text</turn>`` and a newline.  In role and text, a
backslash goes before each backslash, ``<`` and ``#``, in the role before ``:``
too, so control strings in texts can't be taken for the template's.  Tokens
are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table

PACK_CHARS = 1 << 16
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
NODE = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int64()), ("ancestors", pa.list_(SPAN)), ("loss", pa.list_(SPAN))])
LEAF = pa.struct([("path", pa.binary()), ("node", pa.int32())])
PACK = pa.schema([("text", pa.string()), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(LEAF))])
_SPAN = "struct<start:long,stop:long>"
PACK_DDL = f"text string, nodes array<struct<parent:int,start:long,stop:long,position:long,ancestors:array<{_SPAN}>,loss:array<{_SPAN}>>>, leaves array<struct<path:binary,node:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("#", "\\#")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and stops in it."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation; anything but whole turns is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class _Pack:
    def __init__(self):
        self.text, self.size, self.nodes, self.leaves = [], 0, [], []
        self.stack: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation and their nodes

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.stack)) and self.stack[n][0] == turns[n]:
            n += 1
        return n

    def add(self, path: bytes, turns: list[tuple[str, str]], loss_role: str) -> None:
        del self.stack[self.shared(turns) :]
        for turn in turns[len(self.stack) :]:
            text, lo, hi = format_turn(*turn)
            parent = self.stack[-1][1] if self.stack else -1
            ancestors: list[dict] = []
            position = 0
            if parent >= 0:
                above = self.nodes[parent]
                position = above["position"] + above["stop"] - above["start"]
                ancestors = [dict(a) for a in above["ancestors"]]
                if ancestors and ancestors[-1]["stop"] == above["start"]:
                    ancestors[-1]["stop"] = above["stop"]
                else:
                    ancestors.append({"start": above["start"], "stop": above["stop"]})
            loss = [{"start": self.size + lo, "stop": self.size + hi}] if turn[0] == loss_role else []
            self.nodes.append({"parent": parent, "start": self.size, "stop": self.size + len(text), "position": position, "ancestors": ancestors, "loss": loss})
            self.stack.append((turn, len(self.nodes) - 1))
            self.text.append(text)
            self.size += len(text)
        self.leaves.append({"path": path, "node": self.stack[-1][1] if self.stack else -1})

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"text": "".join(self.text), "nodes": self.nodes, "leaves": self.leaves}], schema=PACK)


def _packing(loss_role: str, pack_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for path, turns in zip(batch.column("path").to_pylist(), batch.column("turns").to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                new = sum(len(x) for t in turns[pack.shared(turns) :] for x in t)
                if pack.leaves and pack.size + new > pack_chars:
                    yield pack.row()
                    pack = _Pack()
                pack.add(path, turns, loss_role)
        if pack.leaves:
            yield pack.row()

    return run


def conversations_of(rows: DataFrame) -> DataFrame:
    """Each conversation's turns in order, and its path, 8 bytes for each turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = rows.groupBy("conv_id").agg(turns.alias("turns"))
    step = lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")
    return whole.withColumn("path", F.unhex(F.array_join(F.transform("turns", step), "")))


def pack(conversations: DataFrame, loss_role: str = "assistant", pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs (text, nodes, leaves) of conversations (turns, path); leaves name the node at which a path ends.

    Each distinct path is packed once.  A conversation longer than a pack is a
    pack of its own.  An empty table gives no packs.
    """
    distinct = conversations.groupBy("path").agg(F.first("turns").alias("turns"))
    return distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_packing(loss_role, pack_chars), PACK_DDL)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What packs say about each path, read from text, intervals and loss spans alone."""
    for batch in batches:
        for row in batch.to_pylist():
            text, nodes, out = row["text"], row["nodes"], []
            for leaf in row["leaves"]:
                chain, at = [], leaf["node"]
                while at >= 0:
                    chain.append(nodes[at])
                    at = nodes[at]["parent"]
                last = chain[0] if chain else {"ancestors": [], "start": 0, "stop": 0}
                whole = "".join(text[s["start"] : s["stop"]] for s in [*last["ancestors"], last])
                turns = parse(whole)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for node in reversed(chain) for s in node["loss"])
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((leaf["path"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(packs: DataFrame) -> DataFrame:
    """One row per path of the packs, with the digests of its turns and of the text under the loss mask."""
    return packs.mapInArrow(_unpack, "path binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text), formatted, packed and read back.

    Null texts and roles are empty.  Turns are ordered by turn (null first), then
    role and text; repeated rows are turns of their own.  Rows whose conv_id is
    null are one conversation.  Other columns are ignored.
    """
    whole = conversations_of(rows.select("conv_id", "turn", "role", "text"))
    found = read_back(pack(whole))
    return whole.select("conv_id", F.col("path").alias("_path")).join(found, F.col("_path") == found["path"]).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one numbered -7 whose texts look like the template."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<', '\<'), '#', '\#')"
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length({_ESCAPED.format("role")}) + length(role) - length(replace(role, ':', '')) + length({_ESCAPED.format("text")}) + length('### : </turn>') + 1) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""
