"""Rule bitmask ledger: every rule is evaluated once, policies and ablations are bit arithmetic on what was stored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, fields_of, table, whole_row, words_of

WINDOW = 8

#: Rules by bit, lowest first: name and failure condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 16 * n_words)"),
    ("exclamations", "10 * n_exclaims > 5 * n_words"),
    ("capitals", "2 * n_capitals > n_letters and n_letters >= 100"),
    ("stutters", "2 * n_stutters > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: A policy is the set of rules whose failure rejects. Policies are only ever added, never altered.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "web-1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "web-2": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["word_length"] | BIT["exclamations"] | BIT["capitals"] | BIT["stutters"],
}
CURRENT = "web-2"


def _count(text: Column, pattern: str) -> Column:
    """Code points of a text that match a class: what is lost when they are removed."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """(row, m): the input row as one struct, and its measurements as another."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    step = docs.select(whole_row(docs).alias("row"), t.alias("t")).select("row", "t", words_of(F.col("t")).alias("w"), lines.alias("lines"))
    hashes = F.when(
        F.size("w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("h", hashes)
    # only texts in which some window recurs go on to find where
    sorted_h = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.withColumn("s", sorted_h)
    h_at = lambda i: F.get(F.col("s"), i)["h"]
    again = F.filter("s", lambda x, i: F.coalesce(x["h"] == h_at(i - 1), F.lit(False)) | F.coalesce(x["h"] == h_at(i + 1), F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    bare = F.regexp_replace("t", WS, "")
    return step.select(
        "row",
        F.struct(
            F.size("w").cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            _count(F.col("t"), "[#*$%&|<>]+").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.size("s") == 0, F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            _count(F.col("t"), "!+").alias("n_exclaims"),
            _count(F.col("t"), r"\p{Lu}+").alias("n_capitals"),
            F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            F.size(F.filter("w", lambda w, i: w == F.get(F.col("w"), i + 1))).cast("long").alias("n_stutters"),
        ).alias("m"),
    )


def ledger_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, m, fail_bits): the input row as a struct, its measurements, and bit i set where rule i fails.

    A null text is measured as an empty one; repeated rows are measured each; very long texts are a row's work. n_repeat_words
    compares windows within a text by 64-bit hashes.
    """
    measured = _measured(docs, text)
    fields = [x.name for x in measured.schema["m"].dataType.fields]
    bits = None
    for i, (_, condition) in enumerate(RULES):
        condition = re.sub(rf"\b({'|'.join(fields)})\b", r"m.\1", condition)
        bit = F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    # behind a generator, so that a policy's filter cannot be pushed down to where it would evaluate the rules anew
    return measured.select("row", "m", F.explode(F.array(bits.cast("long"))).alias("fail_bits"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements (struct m) and fail_bits, as ledger_rows() has them.

    Where docs has a column of either name already, the ledger's gets underscores behind it: m_, fail_bits_.
    """
    taken = {c.lower() for c in docs.columns}
    free = lambda c: c if c not in taken else free(c + "_")
    return ledger_rows(docs, text).select(*fields_of("row", docs.columns), F.col("m").alias(free("m")), F.col("fail_bits").alias(free("fail_bits")))


def apply_policy(led: DataFrame, version: str = CURRENT, column: str = "kept") -> DataFrame:
    """The ledger with a boolean column: true where no rule of the policy failed."""
    return led.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects, which would be kept without it.

    The ledger is first summed to one row per failure pattern, at most 2 to the number of rules.
    """
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & POLICIES[version]])
    seen = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]))
    each = patterns.select("fail_bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(seen == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of docs that no rule of the policy rejects; columns and their names stay, whatever they are."""
    return apply_policy(ledger_rows(docs, text), version).where("kept").select(*fields_of("row", docs.columns))


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_policy(ledger_rows(docs))
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & F.col("kept")).alias("kept"),
        "fail_bits",
    )
