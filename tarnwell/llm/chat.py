"""Preference formatting of pairs of conversations.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import let, running

#: How a turn is written; the opening mark is broken where a text holds it.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn; a null role or text is empty."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit(CLOSE + "\n"), safe(text), F.lit(END))


def _trained(turns: Column, trained_role: str) -> Column:
    """Character runs (s, e) of the rendered turns that are learned: those of the trained role after their opening line."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def runs(t: Column, end: Column) -> Column:
        learned = F.filter(F.sequence(F.lit(1), F.size(t)), lambda k: F.element_at(t, k)["role"].eqNullSafe(F.lit(trained_role)))
        begin = lambda k: F.element_at(end, k) - F.length(F.element_at(t, k)["shown"]) + F.instr(F.element_at(t, k)["shown"], "\n")
        return F.transform(learned, lambda k: F.struct(begin(k).cast("int").alias("s"), F.element_at(end, k).cast("int").alias("e")))

    ends = lambda t: running(F.transform(t, lambda x: F.length(x["shown"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(F.size(turns) > 0, let(turns, lambda t: let(ends(t), lambda end: runs(t, end)))).otherwise(none)


def preference_pairs(turns: DataFrame, pair: str, side: str, turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """pair_id, n_prompt, n_chosen, n_rejected (turns), prompt, chosen, rejected, chosen_mask and rejected_mask for every pair.

    turns: one row for each turn; `pair` names the pair, and `side` is 0 for the chosen conversation and 1 for the rejected.
    The longest common prefix of turns (role and text alike, null like null) is rendered once as the prompt, the rest of
    each side as its completion.  A mask has the completion's character runs (s, e) that are learned, those of the trained
    role; the prompt is never learned.  Two equal conversations have empty completions; where one side is missing, its
    columns are null and the other's turns are all completion.  Turns are ordered by turn, then role, then text, nulls
    first, so ties and repeated rows have one result.  A turn without a pair is a pair of its own with a null pair_id, so
    such rows never meet in one group; a pair is one row of the result and its turns are gathered for it.  An empty table
    gives no rows; other columns are not read.
    """
    given = turns.select(F.col(pair).alias("pair_id"), F.col(side).cast("int").alias("side"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    packed = F.struct("side", "turn", "role", "text")
    known = given.where("pair_id is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list(packed)).alias("t"))
    alone = given.where("pair_id is null").select("pair_id", F.array(packed).alias("t"))
    both = known.union(alone)
    of = lambda k: F.transform(F.filter("t", lambda x: x["side"] == k), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), rendered(x["role"], x["text"]).alias("shown")))

    def common(c: Column, r: Column) -> Column:
        m = F.least(F.size(c), F.size(r))
        same = F.zip_with(F.slice(c, F.lit(1), m), F.slice(r, F.lit(1), m), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
        return F.when(F.array_contains(same, False), F.array_position(same, False).cast("int") - 1).otherwise(m)

    def formatted(c: Column, r: Column, n: Column) -> Column:
        show = lambda x: F.array_join(F.transform(x, lambda t: t["shown"]), "")
        rest = lambda x: F.slice(x, n + 1, F.size(x) - n)
        there = lambda x, v: F.when(F.size(x) > 0, v)
        return F.struct(
            n.cast("long").alias("n_prompt"), there(c, (F.size(c) - n).cast("long")).alias("n_chosen"), there(r, (F.size(r) - n).cast("long")).alias("n_rejected"),
            show(F.slice(c, F.lit(1), n)).alias("prompt"), there(c, show(rest(c))).alias("chosen"), there(r, show(rest(r))).alias("rejected"),
            there(c, _trained(rest(c), trained_role)).alias("chosen_mask"), there(r, _trained(rest(r), trained_role)).alias("rejected_mask"),
        )

    out = let(of(0), lambda c: let(of(1), lambda r: let(common(c, r), lambda n: formatted(c, r, n))))
    return both.select("pair_id", out.alias("o")).select("pair_id", "o.*")


def runs_text(mask: Column) -> Column:
    """(s, e) runs as text: s-e, joined by commas."""
    return F.array_join(F.transform(mask, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
