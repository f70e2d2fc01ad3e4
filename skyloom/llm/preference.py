"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

Turns are ordered by number, role and text, and counted on each side. The longest common prefix ends at the first count
that only one side has with this role and text, so it takes one grouping of both sides and a minimum per pair. Nothing gathers a
whole conversation: the result has a row per turn, each with its rendered text, its place in the string of its part, and
the span that a loss may see. ``assembled`` joins the strings of pairs that fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.llm.common import stored
from skyloom.slicing import running_total, with_ordinal

#: The marks of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SLICE = 1024  # turns numbered in one task


def _turns(side: DataFrame, pair: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    """``pair, turn, role, text`` and the side's name; null roles and texts as empty ones."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = side.select(F.col(f"`{pair}`").alias("pair"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    return rows.where("pair IS NOT NULL").withColumn("side", F.lit(name))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def preference_segments(
    chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per turn: ``pair_col``, ``part`` (prompt, chosen, rejected), ``position`` (from 0 in the part), ``role``,
    ``rendered``, ``start`` (characters before it in the string of the part), ``train``, ``train_start``, ``train_length``.

    The prompt holds the longest common prefix once and is masked whole. In completions, turns of ``trained_role`` are
    trained on: text and end mark, not the header. Null roles and texts count as empty; a turn given twice on a
    side counts once; turns of one number go by role and text, and the sides may number them differently; rows without a pair id stay out. Pairs with only one side have an empty
    prompt and one completion; pairs without any difference state no preference and are left out. Empty tables give an
    empty result.
    """
    names = pair_col, turn_col, role_col, text_col
    rows = _turns(chosen, *names, "chosen").unionByName(_turns(rejected, *names, "rejected"))
    has = lambda side: F.max((F.col("side") == side).cast("int")) == 1
    place = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 40))).cast("long")
    counted = with_ordinal(rows.distinct(), ["pair", "side"], [F.asc_nulls_first("turn"), "role", "text"], [place], "pos")
    both = counted.groupBy("pair", "pos", "role", "text").agg(has("chosen").alias("in_chosen"), has("rejected").alias("in_rejected"))
    both = stored(both)  # read twice
    ends = both.where("NOT (in_chosen AND in_rejected)").groupBy("pair").agg(F.min("pos").alias("end"))
    parts = F.when(F.col("pos") < F.col("end"), F.array(F.lit("prompt"))).otherwise(
        F.filter(F.array(F.when(F.col("in_chosen"), F.lit("chosen")), F.when(F.col("in_rejected"), F.lit("rejected"))), lambda p: p.isNotNull())
    )
    shown = both.join(ends, "pair").select("pair", "pos", "role", "text", F.explode(parts).alias("part"))
    shown = shown.withColumn("rendered", _rendered(F.col("role"), F.col("text")))
    sums = {"position": F.lit(1).cast("long"), "start": F.length("rendered").cast("long")}
    placed = running_total(shown, ["pair", "part"], ["pos"], [F.floor(F.col("pos") / SLICE).cast("long")], sums, inclusive=False)
    train = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    head = F.length(F.col("role")) + len(OPEN) + 1
    return placed.select(
        F.col("pair").alias(pair_col), "part", F.col("position").cast("long").alias("position"), "role", "rendered", F.col("start").cast("long").alias("start"), train.alias("train"),
        F.when(train, F.col("start") + head).cast("long").alias("train_start"), F.when(train, F.length("rendered") - head).cast("long").alias("train_length"),
    )


def assembled(segments: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """One row per pair: ``prompt``, ``chosen``, ``rejected`` and the trained spans of both. For pairs that fit a row."""
    part = lambda name, value: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("position", value))))
    text = lambda name: F.array_join(F.transform(part(name, F.col("rendered").alias("v")), lambda s: s["v"]), "")
    span = F.struct("train_start", "train_length").alias("v")
    spans = lambda name: F.transform(F.filter(part(name, span), lambda s: s["v"]["train_start"].isNotNull()), lambda s: s["v"])
    return segments.groupBy(pair_col).agg(
        text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"),
        spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"),
    )


def swapped_answers(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations: the rejected one ends with another conversation's last answer.

    A conversation is used up to its last assistant turn. Its partner is the next conversation in the order of the md5 of
    the ids, the first one after the last. Columns: ``pair_id`` (the conversation's id), ``turn``, ``role``, ``text``.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("pair_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text")
    ).where("pair_id IS NOT NULL AND turn IS NOT NULL")
    last = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    key = F.md5(F.col("pair_id").cast("string"))
    last = stored(last.withColumn("key", key))
    placed = stored(with_ordinal(last, [], ["key", "pair_id"], [F.substring("key", 1, n) for n in (2, 4)], "place"))
    n = last.agg(F.count(F.lit(1)).alias("n"))
    following = placed.select(F.col("place").alias("wanted"), F.col("last.text").alias("other"))
    pairs = placed.withColumn("wanted", F.col("place") % F.lit(n.first()["n"] or 1) + 1).join(following, "wanted").select("pair_id", "last", "other")
    pairs = stored(pairs)
    kept = rows.join(pairs, "pair_id").where(F.col("turn") <= F.col("last.turn"))
    answer = (F.col("turn") == F.col("last.turn")) & F.col("role").eqNullSafe(F.lit("assistant")) & F.coalesce("text", F.lit("")).eqNullSafe(F.col("last.text"))
    chosen = kept.select("pair_id", "turn", "role", "text")
    return chosen, kept.select("pair_id", "turn", "role", F.when(answer, F.col("other")).otherwise(F.col("text")).alias("text"))
