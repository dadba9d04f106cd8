"""Chat formatting as packed prefix trees (operator 2)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import partitions

#: Control strings of the template. A turn is TURN role TEXT text END.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What would be a control string, here or in common templates: its bracket gets a backslash, and so does one that has some.
CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)")
PARSED = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
#: Code points from which a pack is closed after its conversation. A tree that outgrows it goes on in the next pack.
PACK = 65_536
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text) if "\\" in text else text


PACK_SCHEMA = (
    "text string, starts array<int>, ends array<int>, parents array<int>, positions array<int>, subtree_ends array<int>, "
    "loss_starts array<int>, loss_ends array<int>, seen_from array<int>, seen_starts array<int>, seen_ends array<int>, conv_ids array<bigint>, leaves array<int>"
)


class Pack:
    """A sequence under way: nodes in depth-first order; path is the branch that is open."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0
        self.rows = {k: [] for k in ("starts", "ends", "parents", "positions", "subtree_ends", "loss_starts", "loss_ends", "seen_from", "seen_starts", "seen_ends", "conv_ids", "leaves")}
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        r, shared = self.rows, 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        for _, node in self.path[shared:]:
            r["subtree_ends"][node] = self.size
        del self.path[shared:]
        for role, text in turns[shared:]:
            parent = self.path[-1][1] if self.path else -1
            head, said = TURN + escape(role) + TEXT, escape(text)
            node, start = len(r["starts"]), self.size
            self.parts += (head, said, END)
            self.size += len(head) + len(said) + len(END)
            loss = (start + len(head), start + len(head) + len(said)) if role == ASSISTANT else (-1, -1)
            seen = []
            if parent >= 0:
                seen = [*zip(*[r[k][r["seen_from"][parent] : r["seen_from"][parent + 1] if parent + 1 < node else None] for k in ("seen_starts", "seen_ends")], strict=True)]
                if seen and seen[-1][1] == r["starts"][parent]:
                    seen[-1] = (seen[-1][0], r["ends"][parent])
                else:
                    seen.append((r["starts"][parent], r["ends"][parent]))
            for k, v in (("starts", start), ("ends", self.size), ("parents", parent), ("positions", r["positions"][parent] + r["ends"][parent] - r["starts"][parent] if parent >= 0 else 0), ("subtree_ends", self.size), ("loss_starts", loss[0]), ("loss_ends", loss[1]), ("seen_from", len(r["seen_starts"]))):
                r[k].append(v)
            r["seen_starts"] += [a for a, _ in seen]
            r["seen_ends"] += [b for _, b in seen]
            self.path.append(((role, text), node))
        r["conv_ids"].append(conv_id)
        r["leaves"].append(self.path[-1][1] if self.path else -1)

    def row(self) -> dict:
        for _, node in self.path:
            self.rows["subtree_ends"][node] = self.size
        return {"text": "".join(self.parts), **self.rows}


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations sorted by path become packs; only the pack under way is in memory."""
    pack = Pack()
    for pdf in batches:
        done = []
        for conv_id, roles, texts in zip(pdf["conv_id"].astype(object), pdf["roles"], pdf["texts"], strict=True):
            pack.add(None if pd.isna(conv_id) else int(conv_id), list(zip(roles, texts, strict=True)))
            if pack.size >= PACK:
                done.append(pack.row())
                pack = Pack()
        if done:
            yield pd.DataFrame(done)
    if pack.rows["conv_ids"]:
        yield pd.DataFrame([pack.row()])


def prefix_packs(turns: DataFrame) -> DataFrame:
    """Packs of conversations (conv_id, turn, role, text) as prefix trees, each node's text once, depth first.

    A pack has the text, and per node: its interval, its parent, the position id of its first code point (positions run
    along the path from the root), where its subtree ends, the interval under the loss mask (assistant texts; -1: none),
    and the intervals of its ancestors, the only ones it attends to, in seen_starts and seen_ends from seen_from on.
    leaves[i] is the last node of conversation conv_ids[i]. Units are code points.

    Sorting conversations by their turns is depth-first order, and neighbours share the longest prefixes, so a range
    partition and a sort build the trees as a stream. A first turn that a third of all conversations share spreads over
    partitions and packs; its text is once in each pack.

    Turns sort by turn (null first), role, text. Null texts and roles are empty; a null conv_id is a conversation;
    equal rows are turns of their own; empty tables give no packs.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: t["role"]).alias("roles"), F.transform("t", lambda t: t["text"]).alias("texts"), F.transform("t", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))
    convs = convs.repartitionByRange(partitions(turns.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return convs.select("conv_id", "roles", "texts").mapInPandas(packed, PACK_SCHEMA)


def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for p in pdf.itertuples(index=False):
            out = []
            for conv_id, leaf in zip(p.conv_ids, p.leaves, strict=True):
                first, last = p.seen_from[leaf], p.seen_from[leaf + 1] if leaf + 1 < len(p.seen_from) else len(p.seen_starts)
                whole = "".join(p.text[a:b] for a, b in zip(p.seen_starts[first:last], p.seen_ends[first:last], strict=True)) + p.text[p.starts[leaf] : p.ends[leaf]]
                turns = [(unescape(role), unescape(text)) for role, text in PARSED.findall(whole)]
                path, node = [], leaf
                while node >= 0:
                    path.append(node)
                    node = p.parents[node]
                loss = "".join(unescape(p.text[p.loss_starts[n] : p.loss_ends[n]]) for n in reversed(path) if p.loss_starts[n] >= 0)
                digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv_id, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(whole)))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(control).alias("text"))
    return prefix_packs(turns.unionByName(extra)).mapInPandas(read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


OP2_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
formatted AS (SELECT *, '<|turn|>' || regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') || '<|text|>' || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') || '<|end|>' AS said FROM turns),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS plain,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(said))::BIGINT AS formatted_chars FROM formatted GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(plain) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""
