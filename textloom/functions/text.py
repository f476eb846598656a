"""Text to tokens, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split sees it, line ends as
# str.splitlines sees them, and Unicode word characters. All three classes mean
# the same in Java and RE2.
SPACE = r"[\t-\r\x1C-\x1F \x{85}\p{Z}]+"
LINE_END = r"\r\n|[\n-\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]{2,}"
CODE_TOKEN = r"[\p{L}\p{N}_]+|[^\t-\r\x1C-\x1F \x{85}\p{Z}\p{L}\p{N}_]"


def drop_blank(tokens: Column) -> Column:
    return F.array_remove(tokens, "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return drop_blank(F.split(text, SPACE))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""

    def trimmed(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text, LINE_END, -1), trimmed)


def brace_sentences(text: Column) -> Column:
    """Pieces that end at a closing brace at the end of a line, empty ones dropped."""
    return drop_blank(F.split(F.concat(text, F.lit("\n")), r"\}\n", -1))


def code_tokens(text: Column) -> Column:
    """Lower-cased identifiers, numbers and single punctuation marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(CODE_TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside ``body``, so lambdas do not evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one row, without leaving the row.

    Equal tokens are adjacent after a sort; a run's length is the distance
    between its start and the next one. No (document, term) shuffle is needed.
    """

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        found = let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(s, k + 1), F.size(ordered)) - start).cast("long").alias("tf"),
                ),
            ),
        )

        return F.when(F.size(ordered) > 0, found).otherwise(empty)

    return let(F.sort_array(tokens), runs)
