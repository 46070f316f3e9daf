"""Quality rules whose cut-offs follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, settle

#: What separates words, and the characters counted as symbols.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
FACTS = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
#: Leading bits of a value that a sketch keeps: cut-offs are within 1/64 of the exact quantile.
SKETCH_BITS = 7


@dataclass(frozen=True)
class Fence:
    """Bounds of a rule: the quartiles of a group widened by ``times`` their distance; ``both``: below too.

    Where a measure is zero for most of a group its quartiles are zero, and so is the upper bound. ``few`` of what the
    column ``part`` counts never fail a rule, so that a text is not cut for one symbol or one line.
    """

    times: int = 4
    both: bool = False
    part: str | None = None
    few: int = 0


#: Rules by name, in millionths. Four symbols, three repeated lines, and 31 words (two windows of eight that are met
#: twice hold 32 at least) pass everywhere.
RULES: Mapping[str, Fence] = {
    "symbol_share": Fence(part="n_symbols", few=4),
    "dup_line_share": Fence(part="n_dup_lines", few=3),
    "repeat_share": Fence(part="n_repeat_words", few=31),
    "word_length": Fence(both=True),
}
#: Values that a language and source must have for quartiles of its own; with fewer it has its language's.
LEAST_VALUES = 20


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words inside windows of 8 that occur at least twice in the text, first ones included.

    Windows get exact ranks by doubling: pairs, fours, eights.
    """
    if window != 8:
        raise ValueError("windows of 8 words only")
    if len(words) < 9:
        return 0
    known: dict[str, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    for step in (1, 2, 4):
        ranks = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        _, ranks, counts = np.unique(ranks, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[ranks] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + 8, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def facts(docs: DataFrame) -> DataFrame:
    """What the rules look at, from every whole text; a null text has no words. No shuffle."""

    def rows(batches):
        for batch in batches:
            out = {name.split()[0]: [] for name in FACTS.split(", ")}
            out |= {name: batch[name] for name in ("doc_id", "lang", "source")}
            for text in batch["text"]:
                text = text or ""
                words = WORD.findall(text)
                lines = [line for line in text.split("\n") if WORD.search(line)]
                values = (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines))
                for name, value in zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), values):
                    out[name].append(value)
            yield out

    needed = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"))]
    return map_rows(docs.select(*needed), rows, FACTS)


def measured() -> dict[str, Column]:
    """The rules' values in whole millionths; null for a text without words."""

    def share(part: str, whole: str) -> Column:
        return F.expr(f"CASE WHEN {whole} > 0 THEN (1000000 * {part}) DIV {whole} END")

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def sketch(values: DataFrame, keys: list[str], names: list[str], *, bits: int = SKETCH_BITS) -> DataFrame:
    """Counts per bucket of the named integer columns, per ``keys``: keys, rule, bucket, n.

    A bucket holds the values that agree in their leading ``bits`` bits, so sketches of parts of the data merge
    by adding counts, in any order, with the same result; a group has at most a few thousand buckets.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("value")) for n in names))).alias("p")
    shift = F.expr(f"greatest(0, length(bin(p.value)) - {bits})")
    rows = values.select(*keys, pairs).where("p.value IS NOT NULL").select(*keys, F.col("p.rule").alias("rule"), F.col("p.value").alias("value"), shift.alias("shift"))
    return rows.select(*keys, "rule", F.expr("shiftleft(shiftright(value, shift), shift)").alias("bucket")).groupBy(*keys, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups: those of all groups that agree in ``keys``, added up."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and rule: q1 and q3, the first buckets that reach a quarter and three quarters of the count, and the count."""
    group = Window.partitionBy(*keys, "rule")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    return ranked.groupBy(*keys, "rule").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"),
        F.max("all").alias("n"),
    )


def fences(sketches: DataFrame, group: str, within: str, rules: Mapping[str, Fence] = RULES) -> DataFrame:
    """One row per ``group`` and ``within`` (a source in its language): ``<rule>_low`` and ``<rule>_high``.

    Quartiles are the lower ends of buckets, so the upper bound is from the upper end, a 64th of it above.
    Where a source has fewer than ``LEAST_VALUES`` values, the quartiles are those of its group's merged sketch.
    """
    wide = quartiles(merged(sketches, [group]), [group]).select(F.col(group).alias("of group"), F.col("rule").alias("of rule"), F.col("q1").alias("wide q1"), F.col("q3").alias("wide q3"))
    own = quartiles(sketches, [group, within])
    both = own.join(wide, F.col(group).eqNullSafe(F.col("of group")) & (F.col("rule") == F.col("of rule")))
    enough = F.col("n") >= LEAST_VALUES
    chosen = both.select(group, within, "rule", *(F.when(enough, F.col(q)).otherwise(F.col(f"wide {q}")).alias(q) for q in ("q1", "q3")))
    columns = []
    for name, fence in rules.items():
        own_rule = F.col("rule") == name
        width = fence.times * (F.col("q3") - F.col("q1"))
        columns.append(F.max(F.when(own_rule, F.col("q3") + F.shiftright("q3", SKETCH_BITS - 1) + width)).alias(f"{name}_high"))
        columns.append(F.max(F.when(own_rule, F.col("q1") - width if fence.both else F.lit(0))).alias(f"{name}_low"))
    return chosen.groupBy(group, within).agg(*columns)


def quality_rules(docs: DataFrame, rules: Mapping[str, Fence] = RULES) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rule fails, else true when every measured value lies within the fences
    of the document's language and source, or is made of few counts. A document without words fails the base rule. Null
    languages or sources form groups of their own; equal rows each get their row; an empty table gives an empty result.
    Texts are read once: the counts are settled, then sketched and joined with the fences (one row per
    language and source), which are settled too, so they are broadcast only by their real size.
    """
    keys = ["lang", "source"]
    known = settle(facts(docs))
    values = known.withColumns(measured())
    sketches = settle(sketch(values, keys, list(rules)))
    bounds = settle(fences(sketches, *keys, rules)).withColumnsRenamed({k: f"of_{k}" for k in keys})
    joined = values.join(bounds, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for name, fence in rules.items():
        passes = F.coalesce(F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(False))
        within &= passes | (F.col(fence.part) <= fence.few) if fence.part else passes
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*counts, base_failed.alias("base_failed"), (~base_failed & within).alias("kept"))
