r"""Chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) are joined with themselves until every node knows its root: in each
round a node's pointer, 2^k steps up, is continued by the pointer of the node it has reached, with the sum of scores on
the way, so a path of length n takes log2(n) rounds and no node carries its path. A tree's best leaves by mean score
are chosen (top-k in two steps, so that a tree with a third of all branches is not one task's). Their paths are then
listed by the rounds' pointers, the longest first: each round every listed node lists the one 2^k steps above it, so
the rows are the chosen paths' nodes and no more. Texts are joined to them, and each path becomes one conversation.

Template: an assistant's turn is <s>TEXT</s>, any other is [INST] ROLE newline TEXT [/INST]. A control string inside
a text or role gets a backslash after its first character (one more if it has some), which reading takes off; in a
role, backslash and line breaks are escaped too. The loss mask is the spans of code points of assistants' texts.

Null text and role count as empty. A node whose parent is not in its tree is a root. Nodes in or below a ring have
no root and are on no branch. Of rows with the same tree and node one is used (smallest parent, role, text). A null
tree is a tree, a null node a node that none can answer. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.llm.common import dropped, table, tune, written

# The template's control strings.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>"]
#: Salts of the first step of ranking a tree's branches.
SALTS = 64

_ESCAPE = re.compile(r"([\[<])(\\*)(/?(?:INST\]|s>))")
_UNESCAPE = re.compile(r"([\[<])\\(\\*)(/?(?:INST\]|s>))")
_TURN = re.compile(r"\[INST\] (.*?)\n(.*?) \[/INST\]|<s>(.*?)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and its loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            spans.append((at + 3, at + 3 + len(body)))
            out.append(f"<s>{body}</s>")
        else:
            name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
            out.append(f"[INST] {name}\n{body} [/INST]")
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """What format_turns() was given."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        if m[3] is not None:
            out.append(("assistant", unescape(m[3])))
        else:
            name = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
            out.append((name, unescape(m[2])))
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation, from character {at}")
    return out


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def pointers(messages: DataFrame, tree: str, node: str, parent: str, score: str) -> list[DataFrame]:
    """Tables (tree, node, up, total, depth) by round k: the node 2^k steps up (null beyond the root), and the sum of
    scores and the number of the nodes from here to below it. The last has every node that has a root at depth's end.
    """
    c = lambda x: F.col(f"`{x}`")
    rows = messages.groupBy(c(tree).alias("tree"), c(node).alias("node")).agg(F.min(c(parent)).alias("parent"), F.sum(F.coalesce(c(score).cast("double"), F.lit(0.0))).alias("s"), F.count("*").alias("k"))
    rows = written(rows.select("tree", "node", "parent", (F.col("s") / F.col("k")).alias("total")))
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    first = rows.join(known, _same("tree", "t") & (F.col("parent") == F.col("up")), "left").select("tree", "node", "up", "total", F.lit(1).cast("long").alias("depth"))
    out, going = [written(first)], None
    dropped(rows)
    while True:
        open_ = out[-1].filter(F.col("up").isNotNull())
        n = open_.count()
        # on a path to a root some node reaches it in each round; what is left when none does is in or below a ring
        if n == 0 or n == going:
            return out
        going = n
        far = out[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        step = open_.join(far, _same("tree", "t") & (F.col("up") == F.col("n")))
        step = step.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"))
        out.append(written(out[-1].filter(F.col("up").isNull()).unionByName(step)))


def branches(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score", best: int = 1) -> DataFrame:
    """(tree, leaf, rank, at, node): the nodes, from the root at 0 on, of the best paths of each tree from root to leaf.

    best by mean score, null scores as 0; ties to the smaller leaf.
    """
    rounds = pointers(messages, tree, node, parent, score)
    inner = rounds[0].filter(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = rounds[-1].filter(F.col("up").isNull()).join(inner, _same("tree", "t") & (F.col("node") == F.col("p")), "left_anti")
    leaves = leaves.select("tree", "node", "depth", (F.col("total") / F.col("depth")).alias("mean"))
    order = [F.col("mean").desc(), F.col("node")]
    salted = leaves.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("tree", "salt").orderBy(*order))).filter(F.col("r") <= best)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(*order))).filter(F.col("rank") <= best)
    listed = written(last.select("tree", F.col("node").alias("leaf"), "rank", (F.col("depth") - 1).alias("at"), "node"))
    for k in range(len(rounds) - 2, -1, -1):
        # a pointer of round k leads 2^k steps up: from a place under 2^k there is none
        up = rounds[k].filter(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = listed.filter(F.col("at") >= (1 << k)).join(up, _same("tree", "t") & (F.col("node") == F.col("n")))
        further = written(listed.unionByName(above.select("tree", "leaf", "rank", (F.col("at") - (1 << k)).alias("at"), F.col("up").alias("node"))))
        dropped(listed)
        listed = further
    dropped(*rounds)
    return listed


def conversations(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score", best: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): the chosen branches as conversations; loss: spans of code points."""
    tune(messages.sparkSession)
    c = lambda x: F.col(f"`{x}`")
    steps = branches(messages, tree, node, parent, score, best)
    said = messages.groupBy(c(tree).alias("t"), c(node).alias("n")).agg(F.min(F.struct(c(parent).alias("p"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))).alias("m"))
    turns = steps.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", F.col("m.role").alias("role"), F.col("m.text").alias("text")))).alias("turns"))

    @F.pandas_udf("formatted string, loss array<struct<start: int, end: int>>")
    def formatted(turns: pd.Series) -> pd.DataFrame:
        got = [format_turns([(t["role"], t["text"]) for t in x]) for x in turns]
        return pd.DataFrame({"formatted": [g[0] for g in got], "loss": [[{"start": a, "end": b} for a, b in g[1]] for g in got]})

    return turns.withColumn("f", formatted("turns")).select("tree", "leaf", "rank", "f.formatted", "f.loss")


def chains(rows: DataFrame, key: str, order: list[str], text: str = "text", role: str = "role") -> DataFrame:
    """Rows of linear conversations as reply trees: each row answers the one before it."""
    nth = F.row_number().over(W.partitionBy(F.col(f"`{key}`")).orderBy(*order)).cast("long")
    out = rows.select(F.col(f"`{key}`").alias("tree"), nth.alias("node"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"), F.lit(0.0).alias("score"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def op1_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    tune(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    linear = written(chains(rows.unionByName(extra), "conv_id", ["turn", "role", "text"]))
    made = conversations(linear)

    @F.pandas_udf("turns array<struct<role: string, text: string>>, loss_text string")
    def read(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
        turns = [[{"role": r, "text": t} for r, t in read_turns(f)] for f in formatted]
        masked = ["".join(unescape(f[s["start"] : s["end"]]) for s in spans) for f, spans in zip(formatted, loss, strict=True)]
        return pd.DataFrame({"turns": turns, "loss_text": masked})

    back = made.withColumn("b", read("formatted", "loss"))
    joined = F.array_join(F.transform("b.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("b.turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("b.loss_text").cast("long").alias("loss_chars"),
        F.sha2("b.loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g') AS body,
  regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g') AS name FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN 7 + length(body) ELSE 16 + length(name) + length(body) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
