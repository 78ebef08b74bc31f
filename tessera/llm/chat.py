"""Chat formatting: reply trees to conversations, with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_long, as_text, stage

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|br|>"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text without any ``<|``: one backslash more between the two wherever there are none or some."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def template(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and (start, length) in code points of the texts to learn from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), BREAK)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(text)))
    return turns


def reply_chains(rows: DataFrame) -> DataFrame:
    """Turn lists as reply trees: (conv, msg, parent, role, text, score), each turn the reply to the one before.

    Equal turns are ordered by role and text. Null roles and texts are empty; rows without a conversation are one
    conversation of their own.
    """
    rows = rows.select(F.coalesce(as_text("conv_id"), F.lit("")).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(W.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv", n.alias("msg"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jump(at: DataFrame) -> DataFrame:
    """Every message's chain (its topmost message) and place there, by pointers that double their reach each round.

    ``at``: conv, msg, up (the message it hangs on in its chain, null for the topmost). Messages that reply to each other
    in a circle have no topmost one and go.
    """
    p = at.select("conv", "msg", F.coalesce("up", "msg").alias("head"), F.col("up").isNotNull().cast("long").alias("step"))
    p = stage(p, "pointers")
    for _ in range(p.count().bit_length() + 1):  # pointers that still move then go round
        far = p.select("conv", F.col("msg").alias("head"), F.col("head").alias("head2"), F.col("step").alias("step2"))
        q = p.join(far, ["conv", "head"]).select("conv", "msg", F.col("head2").alias("head"), (F.col("step") + F.col("step2")).alias("step"), (F.col("step2") > 0).alias("moved"))
        q = stage(q, "pointers")
        if not q.agg(F.max("moved")).first()[0]:
            break
        p = q.drop("moved")
    return q.where(~F.col("moved")).select("conv", "msg", "head", "step")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, branch, place, msg, role, text) of the ``branches`` best root-to-leaf paths of each conversation.

    Messages with one reply are joined to chains first, by doubling pointers. Then self-joins walk from the chains at
    the roots to their replies, a level of branching each round, until only leaves are left. Branches rank by the mean
    score of their messages, ties by the smaller leaf.
    """
    messages = stage(messages, "messages")
    link = messages.select("conv", "msg", "parent")
    single = link.where("parent IS NOT NULL").groupBy("conv", "parent").agg(F.count("*").alias("replies")).where("replies = 1").select("conv", "parent", F.col("parent").alias("up"))
    chain = _jump(link.join(single, ["conv", "parent"], "left").select("conv", "msg", "up"))
    of = stage(messages.select("conv", "msg", "parent", "score").join(chain, ["conv", "msg"]), "chains")
    sums = of.groupBy("conv", "head").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.max_by("msg", "step").alias("tail"), F.min_by("parent", "step").alias("parent"))
    over = of.select("conv", F.col("msg").alias("parent"), F.col("head").alias("above"))
    tree = stage(sums.join(over, ["conv", "parent"], "left").select("conv", "head", "tail", "score", "n", "above"), "chain-tree")
    step = tree.where("above IS NULL").select("conv", "head", "tail", "score", "n", F.array("head").alias("heads"))
    inner = tree.where("above IS NOT NULL").select("conv", F.col("above").alias("head")).distinct()
    leaves = None
    while True:
        ended = stage(step.join(inner, ["conv", "head"], "left_anti"), "leaves")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        reply = tree.select("conv", F.col("above").alias("head"), F.col("head").alias("next"), F.col("tail").alias("t2"), F.col("score").alias("s2"), F.col("n").alias("n2"))
        step = stage(
            step.join(reply, ["conv", "head"]).select("conv", F.col("next").alias("head"), F.col("t2").alias("tail"), (F.col("score") + F.col("s2")).alias("score"), (F.col("n") + F.col("n2")).alias("n"), F.concat("heads", F.array("next")).alias("heads")),
            "frontier",
        )
        if step.isEmpty():
            break
    order = [F.desc(F.col("score") / F.col("n")), F.col("tail")]
    leaves = leaves.withColumn("salt", F.pmod(F.xxhash64("conv", "tail"), F.lit(64)))
    few = leaves.withColumn("k", F.row_number().over(W.partitionBy("conv", "salt").orderBy(*order))).where(F.col("k") <= branches)
    best = few.withColumn("branch", F.row_number().over(W.partitionBy("conv").orderBy(*order))).where(F.col("branch") <= branches)
    spread = best.select("conv", "branch", F.posexplode("heads").alias("level", "head"))
    texts = messages.select("conv", "msg", "role", "text").join(chain, ["conv", "msg"])
    return spread.join(texts, ["conv", "head"]).select("conv", "branch", F.struct("level", "step").alias("place"), "msg", "role", "text")


def format_trees(messages: DataFrame, *, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """(conv_id, branch, formatted, loss_spans) for the best paths of all reply trees.

    ``messages``: conv (long, or its digits; null or empty: none), msg (long, unique in it), parent (null at a root), role, text, score. Control strings in
    texts and roles are escaped, reversibly. A conversation is one row, as it is one text. Messages whose parent is
    missing, and those that reply to each other in a circle, aren't reached from a root and don't appear. Of equal scores
    the branch with the smaller leaf comes first. Texts may be long: a conversation is one row's work. Other columns are
    left out; an empty table gives an empty table.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct("place", "msg", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    messages = messages.withColumn("conv", F.coalesce(F.col("conv").cast("string"), F.lit("")))
    rows = paths(messages, branches).groupBy("conv", "branch").agg(turns.alias("turns"))

    def formatted(batches):
        for pdf in batches:
            done = [template([(t["role"], t["text"]) for t in own], learn) for own in pdf["turns"]]
            out = pd.DataFrame({"conv_id": [c or None for c in pdf["conv"]], "branch": pdf["branch"], "formatted": [f for f, _ in done]})
            out["loss_spans"] = [[{"start": a, "length": n} for a, n in s] for _, s in done]
            yield out

    return as_long(rows.mapInPandas(formatted, "conv_id string, branch int, formatted string, loss_spans array<struct<start: long, length: long>>"), "conv_id")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations and their masks hold, from these alone."""

    def digests(batches):
        for pdf in batches:
            out = []
            for conv, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"], strict=True):
                turns = parse(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha(whole), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.withColumn("conv_id", as_text("conv_id"))
    return as_long(rows.mapInPandas(digests, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "conv_id")
