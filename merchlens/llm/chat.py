"""Chat formatting of reply trees.

Messages form trees (``tree``, ``id``, ``parent``); each root-to-leaf path is a branch of
the conversation.  Per tree the best branches by score are chosen and each becomes
one conversation text with loss spans.

* **Paths** by iterative self-joins with doubling: after round r every message knows its
  ancestor 2^r steps up and the score sum of the steps between, so log2(depth) joins
  reach the roots.  Each round is written to the shared checkpoint folder.
* **Ranking**: leaves by mean score of their path, then smaller leaf id; ``top`` per tree.
* **Expansion** of the chosen leaves only, back through the same written rounds: a path of
  d messages costs d rows, however many branches were not chosen.
* **Format**: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per message.  Control strings
  (:data:`CONTROL`) inside roles and texts get a backslash after their first
  character, one more if backslashes stand there already, so the text of a message holds none and
  unescaping takes exactly that backslash away.

Nulls: a null text or role is empty, a null score counts 0, a null tree is a tree of its
own; a message without id takes no part.  A parent that is missing makes a message a
root.  Messages on or below a cycle have no root and belong to no path.  Several rows
with one (tree, id) count once: the smallest (parent, role, text).  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.session import materialize

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a tokeniser or a template may take as control strings.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# first character, backslashes, and what makes it a control string
_OPENER = r"([<\[])(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    """Control strings made harmless: one backslash after their first character."""
    return F.regexp_replace(text, _OPENER, r"$1$2\\")


_ESCAPED = re.compile(r"([<\[])(\\*)\\(?=\||/?s>|/?INST\]|</?SYS>>)")


def unescape(text: str) -> str:
    """The text before :func:`escape`."""
    return _ESCAPED.sub(r"\1\2", text)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path_rank, depth, id): the messages of the ``top`` best root-to-leaf paths per tree,
    ``depth`` counting from 0 at the root.  ``messages`` has tree, id, parent, score."""
    m = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.where(F.col("id").isNotNull()).groupBy("tree", "id").agg(F.min_by(F.struct("parent", "score"), F.struct("parent", "score")).alias("p"))
    m = materialize(m.select("tree", "id", "p.parent", "p.score"), "chat-nodes")
    known = m.select(F.col("tree").alias("kt"), F.col("id").alias("kid"))
    step = m.join(known, F.col("tree").eqNullSafe(F.col("kt")) & (F.col("parent") == F.col("kid")), "left")
    # anc: the ancestor ``2^r`` steps up (null beyond the root); total, steps: over the messages before it
    step = step.select("tree", "id", F.col("kid").alias("anc"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    rounds = [materialize(step, "chat-round")]
    done = [rounds[0].where("anc is null")]
    open_, before = rounds[0].where("anc is not null").count(), -1
    while open_ and open_ != before:
        # only messages that have not met their root go on; those that have are still jumped to
        s = rounds[-1].where("anc is not null")
        up = s
        for d in done:
            up = up.unionByName(d)
        up = up.select(F.col("tree").alias("ut"), F.col("id").alias("uid"), F.col("anc").alias("uanc"),
                       F.col("total").alias("utotal"), F.col("steps").alias("usteps"))
        nxt = s.join(up, F.col("tree").eqNullSafe(F.col("ut")) & (F.col("anc") == F.col("uid"))).select(
            "tree", "id", F.col("uanc").alias("anc"), (F.col("total") + F.col("utotal")).alias("total"),
            (F.col("steps") + F.col("usteps")).alias("steps"))
        rounds.append(materialize(nxt, "chat-round"))
        done.append(rounds[-1].where("anc is null"))
        before, open_ = open_, rounds[-1].where("anc is not null").count()
    first = rounds[0]
    parents = first.where("anc is not null").select(F.col("tree").alias("pt"), F.col("anc").alias("pid")).distinct()
    rooted = done[0]
    for d in done[1:]:
        rooted = rooted.unionByName(d)
    leaves = rooted.join(
        parents, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("id") == F.col("pid")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), "id")
    chosen = leaves.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= top)
    paths = chosen.select("tree", "path_rank", (F.col("steps") - 1).alias("depth"), F.col("id").alias("at"))
    for r in range(len(rounds) - 1, -1, -1):
        jump = rounds[r].where("anc is not null").select(F.col("tree").alias("jt"), F.col("id").alias("jid"), "anc")
        up = paths.join(jump, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("at") == F.col("jid"))).select(
            "tree", "path_rank", (F.col("depth") - 2 ** r).alias("depth"), F.col("anc").alias("at"))
        paths = materialize(paths.unionByName(up), "chat-paths")
    return paths.withColumnRenamed("at", "id")


def format_paths(messages: DataFrame, paths: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(tree, path_rank, text, loss): each path as one text; ``loss`` holds the [start, length] code
    point spans of the escaped texts of ``learn_role``."""
    m = (messages.where(F.col("id").isNotNull())
         .select(F.col("tree").alias("mt"), F.col("id").alias("mid"), "parent", F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"))
         .groupBy("mt", "mid").agg(F.min(F.struct("parent", "role", "text")).alias("m")))
    r = paths.join(m, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("id") == F.col("mid"))).select(
        "tree", "path_rank", "depth", (F.col("m.role") == learn_role).alias("learn"),
        F.concat(F.lit(START), escape(F.col("m.role")), F.lit(SEP)).alias("head"), escape(F.col("m.text")).alias("body"))
    r = r.withColumn("size", F.length("head") + F.length("body") + len(END))
    turns = F.array_sort(F.collect_list(F.struct("depth", "learn", "head", "body", "size")))
    g = r.groupBy("tree", "path_rank").agg(turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # running start of each message's body
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(t["learn"], F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))))
            .otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    return g.select("tree", "path_rank", text.alias("text"), spans.alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every message of a formatted conversation."""
    turns = []
    for part in text.split(END)[:-1]:
        role, body = part[len(START):].split(SEP, 1)
        turns.append((unescape(role), unescape(body)))
    return turns


def digest(text: str, loss: list) -> tuple:
    """(n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of a formatted conversation."""
    turns = parse(text)
    h = hashlib.sha256()
    for role, body in turns:
        h.update(f"{role}\n{body}\n".encode())
    learned = [unescape(text[s["start"]:s["start"] + s["length"]]) for s in loss]
    lh = hashlib.sha256("".join(learned).encode())
    return len(turns), h.hexdigest(), sum(map(len, learned)), lh.hexdigest(), len(text)


def digests(formatted: DataFrame, id_col: str) -> DataFrame:
    """The digest columns of formatted conversations, read from their text and spans."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def measured(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = [digest(t, s) for t, s in zip(text, loss)]
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col("tree").alias(id_col), measured("text", "loss").alias("d")).select(id_col, "d.*")


def linear(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each turn replies to the one before (ties: role, text)."""
    order = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), "role", "text")
    r = rows.select(F.col(conv_col), F.col(turn_col), "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return r.select(F.col(conv_col).alias("tree"), "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
