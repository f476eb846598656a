"""License scan: ordered signature rules behind a keyword prefilter. DataFrame operators only.

A text is normalised to words with a space of their own on both sides. Its words are
looked up among the rules' keywords once; most texts hold none and are done. For the
others, the rules that a found keyword opens are matched, and nothing else. Matches are
intervals of words. One is suppressed if another match of the same text contains its
interval and comes from a rule of better priority, or of the same priority and is
longer, or takes the same interval and comes from an earlier rule. This order has no
cycles, so the largest containing match survives, and running maxima over the sorted
intervals find all suppressed ones without comparing pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import kept
from .exact_dedup import lower_ascii
from .license_rules import RULES, Rule, spread

# Fixed value: all ASCII characters but digits and letters, which are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Words of a text, a space on both sides of each, between two more spaces; null counts as empty."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(text), F.lit(" ")), SEPARATORS, "  ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _table(rules: Sequence[Rule]) -> Column:
    """The rules as one constant array."""
    text = lambda value: "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [
        f"named_struct('rule', {i}, 'regex', {text(spread(r.pattern))}, 'keywords', array({', '.join(map(text, r.keywords.split()))}))"
        for i, r in enumerate(rules)
    ]
    return F.expr(f"array({', '.join(rows)})")


def _matches(text: Column, opened: Column) -> Column:
    """Matches of the rules that the found keywords open: (rule, place among its matches, spaces before it, own spaces)."""

    def of_rule(rule: Column) -> Column:
        parts = F.arrays_zip(
            F.transform(F.split(text, rule["regex"], -1), _spaces).alias("gap"),
            F.transform(F.regexp_extract_all(text, rule["regex"], F.lit(0)), _spaces).alias("own"),
        )
        found = F.transform(parts, lambda p, i: F.struct(rule["rule"].alias("rule"), i.alias("i"), p["gap"].alias("gap"), p["own"].alias("own")))
        return F.filter(found, lambda m: m["own"].isNotNull())

    return F.flatten(F.transform(opened, of_rule))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """One row per input row: ``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)``.

    ``detections`` are the matches that no other suppresses, ``(start, end, rule, label)``
    in words, end exclusive, by place. ``n_base`` counts all matches of the base rules,
    suppressed or not, ``first_word`` and ``last_word`` are the least and largest of
    their starts, ``base_labels`` their labels; ``labels`` are those and the labels of the
    detections. ``score`` is the largest relevance of a detection, 0 without any. Null text
    counts as empty and has no words. Rows with the same id are scanned apart, a null id
    is kept. An empty table gives no rows; columns that are not named are not read.
    """
    keywords = sorted({w for r in rules for w in r.keywords.split()})
    known, table = F.array(*map(F.lit, keywords)), _table(rules)
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,own:int>>")

    def scanned(text: Column) -> Column:
        opened = lambda held: F.filter(table, lambda r: F.arrays_overlap(r["keywords"], held))
        found = lambda held: F.when(F.size(held) > 0, let(opened(held), lambda o: _matches(text, o))).otherwise(none)
        n_words = ((_spaces(text) - 2) / 2).cast("long")
        held = F.array_intersect(F.split(text, "  "), known)
        return let(held, lambda h: F.struct(n_words.alias("n_words"), found(h).alias("found")))

    # The struct is written as it is: taken apart here, the optimizer would evaluate it once for each field.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), let(normalised(F.col(text_col)), scanned).alias("s")
    )
    rows = kept(rows, "license-matches").select("row", "id", "s.n_words", "s.found")

    traits = [(i, r.label, r.priority, float(r.relevance), r.base) for i, r in enumerate(rules)]
    traits = F.broadcast(docs.sparkSession.createDataFrame(traits, "rule int, label string, priority int, relevance double, base boolean"))
    upto = Window.partitionBy("row", "rule").orderBy("i")
    spans = (
        rows.filter(F.size("found") > 0)
        .select("row", F.inline("found"))
        .withColumn("after", F.sum(F.col("gap") + F.col("own")).over(upto))
        .select("row", "rule", ((F.col("after") - F.col("own")) / 2).cast("long").alias("start"), (F.col("after") / 2).cast("long").alias("end"))
        .join(traits, "rule")
    )
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    inside = F.lit(False)
    for level in levels:  # a match is only suppressed by those of its own level or a better one
        reach = F.max(F.when(F.col("priority") <= level, F.col("end"))).over(before)
        inside = inside | ((F.col("priority") == level) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    base, stays = F.col("base"), ~F.col("inside")
    names = lambda flag: F.concat_ws(",", F.array_sort(F.collect_set(F.when(flag, F.col("label")))))
    per_row = spans.withColumn("inside", inside).groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(base).alias("base_labels"),
        names(base | stays).alias("labels"),
        F.max(F.when(stays, F.col("relevance"))).alias("score"),
        F.array_sort(F.collect_list(F.when(stays, F.struct("start", "end", "rule", "label")))).alias("detections"),
    )
    return rows.select("row", "id", "n_words").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("detections", F.array().cast("array<struct<start:bigint,end:bigint,rule:int,label:string>>")).alias("detections"),
    )
