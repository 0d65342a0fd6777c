"""Shared small helpers: words, keys of texts, running folds and safe column names; interim tables come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.interim import dropped, small_side, tidied, written  # noqa: F401

#: Words of the contamination and license contracts: runs of ASCII letters and digits or of any non-ASCII character.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Elements of a block of a running fold.
RUN = 128


def lowered(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of a text; null and empty texts have none."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in joins; null differs from the empty text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("h2"))


def prefixed(df: DataFrame, mark: str = "__in_") -> DataFrame:
    """df with all columns renamed, so that an operator's own columns cannot clash with them."""
    return df.select([F.col(f"`{c.replace('`', '``')}`").alias(mark + c) for c in df.columns])


def let(value: Column, body) -> Column:
    """body(value), with value computed once, however often and in whatever lambda body uses it.

    A column that only a lambda uses is moved into the lambda by Spark's optimizer and then computed for every element; an
    element of a one-element array is a variable, which stays.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, step) -> Column:
    """For each place of an array the fold of its elements up to there, by an associative step.

    An array that grows by concat is copied at each step, so folds run over blocks, and each block starts from the fold of
    the blocks before it.
    """

    def within(base: Column, block: Column) -> Column:
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), base)
        return F.aggregate(block, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(step(last(acc), v))))

    def folded(blocks: Column) -> Column:
        tops = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda b, k: let(F.aggregate(F.slice(t, F.lit(1), k), zero, step), lambda base: within(base, b)))))

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
    blocks = F.transform(starts, lambda k: F.slice(values, k * RUN + 1, RUN))
    return F.when(F.size(values) > 0, let(blocks, folded)).otherwise(F.array().cast("array<bigint>"))


def merged_runs(spans: Column) -> Column:
    """Sorted (s, e) to maximal runs, in time linear in their number."""

    def runs(x: Column, far: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.element_at(x, i)["s"] > F.element_at(far, F.greatest(i - 1, F.lit(1)))))
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.element_at(x, i)["s"].cast("long").alias("s"), F.element_at(far, F.coalesce(F.try_element_at(f, k + 2) - 1, F.size(x))).alias("e"))))

    longest = lambda x: running(F.transform(x, lambda d: d["e"].cast("long")), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return F.when(F.size(spans) > 0, let(spans, lambda x: let(longest(x), lambda far: runs(x, far)))).otherwise(none)
