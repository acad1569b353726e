"""Prefix-target expansion of conversations into training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, MID, END = "<|turn|>", "<|text|>", "<|end|>"
#: Every backslash of an escaped text begins one of these codes, so each can be undone by a plain replacement.
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    """Rewrites a text so that no control string of an angle or square bracket template can occur in it."""
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape(): the backslash comes last, after all codes that begin with one."""
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_targets(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One example per turn of target_role: all preceding turns as context, only that reply trainable.

    turns has conv_id, turn, role, text; other columns are not read. Null roles and texts are empty, turns are
    ordered by turn (null first), then role and text, so ties and repeated rows have one order; null conv_ids make
    one conversation. Turns after the last target come as one more example without a trainable part, so that no
    turn is lost. Returns conv_id, target (index of the trainable turn, null without one), n_turns (turns in this
    example), formatted, loss_start and loss_length (code points of formatted under the loss mask).

    A conversation is the unit of work: its examples are as large together as the square of its length, as the
    expansion demands, and are made as separate rows.
    """
    row = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MID))
    blocks = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == target_role).alias("hit"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("b"),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.size("b")), lambda i: F.get(F.col("b"), i - 1)["hit"] | (i == F.size("b"))
    )
    at = blocks.select("conv_id", "b", F.explode(ends).alias("n"))
    context = F.array_join(F.transform(F.slice("b", F.lit(1), F.col("n") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    last = at.select("conv_id", F.col("n").cast("long").alias("n_turns"), F.get("b", F.col("n") - 1).alias("x"), context.alias("context"))
    return last.select(
        "conv_id",
        F.when(F.col("x.hit"), F.col("n_turns") - 1).alias("target"),
        "n_turns",
        F.concat("context", "x.head", "x.body", F.lit(END)).alias("formatted"),
        F.when(F.col("x.hit"), F.length("context") + F.length("x.head")).otherwise(0).alias("loss_start"),
        F.when(F.col("x.hit"), F.length("x.body")).otherwise(0).alias("loss_length"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as array<struct<role, text>>."""
    quoted = lambda s: s.replace("|", "\\|")
    pieces = F.split(formatted, quoted(END), -1)
    blocks = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), quoted(MID), -1)),
        lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: the turns of the longest, and all text under the loss masks."""
    trained = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    found = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", trained.alias("text"))))).alias("trained"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    return found.select(
        "conv_id",
        parse_turns(F.col("longest")).alias("turns"),
        F.array_join(F.col("trained.text"), "").alias("loss_text"),
        "formatted_chars",
    )


def op7_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    back = read_back(prefix_targets(turns.unionByName(probe)))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(spelled, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
