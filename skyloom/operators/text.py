"""Vocabularies, token encoding, padding, token streams and packing."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.arrays import pad_right
from skyloom.operators.reshape import seeded_hash
from skyloom.slicing import hash_slices, magnitude_slices, ranged, running_total, with_ordinal

# fixed values: every white-space character, as one regular-expression class; the first test decides for plain letters
SPACES = "[[^!-~]&&[\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]+"

BLOCK_BYTES = 16 << 20  # text that meets its dictionary in one step of a task


def _pieces(col, mode: str, lower: bool, delimiter: str | None) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    x = F.lower(x) if lower else x
    if mode == "char":
        return F.split(x, "")
    if mode == "expr":
        x = F.translate(x, "]()", "X")
    elif mode != "word":
        raise ValueError(f"unknown mode {mode!r}")
    elif delimiter is not None:
        return F.split(x, "\\Q" + delimiter + "\\E")
    return F.split(x, SPACES)


def tokenize(col, mode: str = "word", lower: bool = False, delimiter: str | None = None) -> Column:
    """Token array of a text: white-space words, a delimiter's parts, single characters, or list expressions.

    ``expr`` turns ``]`` into ``X``, drops parentheses and splits at white space.
    """
    pieces = _pieces(col, mode, lower, delimiter)
    # only the ends can be empty, so no entry has to be looked at
    return pieces if delimiter is not None and mode == "word" else F.array_remove(pieces, "")


def build_vocab(df: DataFrame, text: str, level: str = "word", specials: Sequence[str] = ("<unk>",), min_freq: int = 0,
                max_size: int | None = None, lower: bool = False, delimiter: str | None = None) -> DataFrame:
    """(token, token_id, n): specials first, then tokens by falling count, ties by token.

    Counts combine map-side, so a token that fills a third of the corpus costs one row per task. The counts are stored
    in ranges of their order, so that encoding does not count the corpus again; numbers follow from the ranges' sizes.
    """
    tokens = df.select(F.explode(_pieces(text, level, lower, delimiter)).alias("token"))
    if delimiter is None or level != "word":
        tokens = tokens.where("token != ''")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    placed = ranged(counts.where(F.col("n") >= min_freq), F.desc("n"), F.asc("token"))
    ranked = with_ordinal(placed, [], [F.desc("n"), "token"], [F.col("_range")], "_no")
    if max_size is not None:
        ranked = ranked.where(F.col("_no") <= max_size)
    if specials:
        listed = F.array(*[F.struct(F.lit(s).alias("token"), F.lit(i).alias("token_id")) for i, s in enumerate(specials)])
        lead = df.sparkSession.range(1).select(F.inline(listed)).withColumn("n", F.lit(None).cast("long"))
        ranked = ranked.where(~F.col("token").isin(*specials))
    body = ranked.select("token", (F.col("_no") - 1 + len(specials)).cast("int").alias("token_id"), "n")
    return lead.unionByName(body) if specials else body


def _looked_up(df: DataFrame, id_col: str, items: Column, weight: Column, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """(id, ``_found``): each entry of ``items`` replaced by its ``value`` in ``table``, or by ``default``.

    Rows form blocks of about ``BLOCK_BYTES`` by their id. Only the distinct entries of a block meet the table, whatever
    its size, so an entry that fills a third of the corpus costs one row per block; the answers come back as the
    block's dictionary, and whole arrays are replaced by it.
    """
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.agg(F.ceil(F.coalesce(F.sum(weight.cast("long")), F.lit(0)) / BLOCK_BYTES)).scalar()
    placed = df.withColumn("_block", F.pmod(F.xxhash64(id_col), F.greatest(blocks, F.lit(least)))).repartition("_block")
    rows = placed.select("_block", id_col, items.alias("_items"))
    # the rows of a block already share a partition: neither the distinct entries nor the last step move texts again
    entries = placed.select("_block", F.explode(F.array_distinct(items)).alias(key)).distinct()
    answers = entries.join(table.select(key, value), key).select(F.col("_block").alias("_at"), key, value)
    kind = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, _found array<{table.schema[value].dataType.simpleString()}>"

    def replace(block: pa.Table, known: pa.Table) -> pa.Table:
        arrays, names = block["_items"].combine_chunks(), known[key].combine_chunks()
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(arrays), 0))
        places = pc.index_in(arrays.flatten(), value_set=names)
        found = known[value].combine_chunks().take(places)
        found = found if default is None else pc.fill_null(found, default)
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        return pa.table({id_col: block[id_col], "_found": pa.ListArray.from_arrays(starts, found)})

    return rows.groupBy("_block").cogroup(answers.groupBy("_at")).applyInArrow(replace, out)


def encode(df: DataFrame, id_col: str, text: str, vocab: DataFrame, l_max: int | None = None, specials: Sequence[str] = ("<unk>",),
           bos: str | None = None, eos: str | None = None, unk: str = "<unk>", level: str = "word", lower: bool = False,
           delimiter: str | None = None) -> DataFrame:
    """(id, ``input_ids``, ``length``); ``l_max`` counts the added begin and end marks. Empty texts give empty rows."""
    tokens = tokenize(text, level, lower, delimiter)
    if l_max is not None:
        tokens = F.slice(tokens, 1, max(l_max - (bos is not None) - (eos is not None), 0))
    specials = list(specials)
    rows = _looked_up(df.select(id_col, text), id_col, tokens, F.octet_length(text), vocab, "token", "token_id", specials.index(unk))
    parts = [F.col("_found")]
    if bos is not None:
        parts.insert(0, F.array(F.lit(specials.index(bos))))
    if eos is not None:
        parts.append(F.array(F.lit(specials.index(eos))))
    return rows.select(id_col, F.concat(*parts).alias("input_ids")).withColumn("length", F.size("input_ids"))


def decode(df: DataFrame, id_col: str, arr: str, vocab: DataFrame, exclude: Sequence[int] = (), sep: str = " ") -> DataFrame:
    """Ids back to text, some ids and those without a token left out."""
    kept = F.filter(arr, lambda i: i.isNotNull() & ~i.isin(*exclude)) if exclude else F.filter(arr, lambda i: i.isNotNull())
    rows = _looked_up(df.select(id_col, arr), id_col, kept, F.size(arr) * 4, vocab, "token_id", "token")
    return rows.select(id_col, F.array_join("_found", sep).alias("text"))


def pad(df: DataFrame, arr: str, length, value, by: Sequence[str] = ()) -> DataFrame:
    """Right-pad arrays and keep their ``length``.

    ``length`` is a number, ``"batch"`` (longest array of the rows that share ``by``) or ``"pow2"`` (next power of two of
    each array). Without ``by`` the whole frame is one batch, and one long row makes all rows long.
    """
    out = df.withColumn("length", F.size(arr))
    if length == "batch":
        goals = df.groupBy(*by).agg(F.max(F.size(arr)).alias("_goal"))
        out = out.join(goals, list(by)) if by else out.withColumn("_goal", goals.scalar())
        return out.withColumn(arr, pad_right(arr, F.col("_goal"), value)).drop("_goal")
    if length == "pow2":
        goal = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(arr), F.lit(1)).cast("double")) - 1e-12)).cast("int")
        return out.withColumn(arr, pad_right(arr, goal, value))
    return out.withColumn(arr, pad_right(arr, int(length), value))


def label_encode(df: DataFrame, col: str, name: str = "label_id") -> DataFrame:
    """Place (from 0) of each value among the sorted distinct values."""
    return df.join(label_table(df, col, name), col)


def label_table(df: DataFrame, col: str, name: str = "label_id") -> DataFrame:
    """Sorted distinct values and their places."""
    symbols = df.select(col).where(F.col(col).isNotNull()).distinct()
    numbered = with_ordinal(ranged(symbols, col), [], [col], [F.col("_range")], "_no")
    return numbered.select(col, (F.col("_no") - 1).cast("int").alias(name))


def _offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices, size: Column) -> DataFrame:
    """Add ``_from``: tokens of the earlier rows."""
    return running_total(df, keys, order, slices, {"_from": size.cast("long")}, inclusive=False)


def _part(arr, first: Column, last: Column) -> Column:
    """Entries first .. last - 1 (from 0), nothing if the range is empty."""
    return F.slice(arr, (F.greatest(first, F.lit(0)) + 1).cast("int"), F.greatest(last - F.greatest(first, F.lit(0)), F.lit(0)).cast("int"))


def _joined_parts(role: str) -> Column:
    """Array parts of a group, put together in stream order."""
    parts = F.array_sort(F.collect_list(F.when(F.size(role) > 0, F.struct("_at", F.col(role).alias("p")))))
    return F.flatten(F.transform(parts, lambda s: s["p"]))


def token_stream(df: DataFrame, id_col: str, arr: str, batch: int, l_max: int, n_context: int = 1) -> DataFrame:
    """Training rows of one long ordered stream: (row, step, ``input_ids``, ``target_ids``).

    The stream is cut to ``batch`` equal rows; each step advances ``l_max / n_context`` tokens and sees up to ``l_max``
    tokens back; targets are the inputs one token later, for the new part only. Arrays are cut, not exploded: a
    document gives one part per step it touches. ``df`` is read twice, so hand over a stored frame.
    """
    if l_max % n_context:
        raise ValueError("n_context must divide l_max")
    step = l_max // n_context
    c = F.col
    floor = lambda x: F.floor(x).cast("long")
    used = df.agg(F.sum(F.size(arr).cast("long"))).scalar()
    placed = _offsets(df.select(id_col, arr).where(F.size(arr) > 0), [], [id_col], magnitude_slices(id_col), F.size(arr))
    docs = placed.withColumn("_used", used).withColumn("_w", floor(c("_used") / batch)).withColumn(
        "_to", F.least(c("_from") + F.size(arr), c("_w") * batch)
    ).where((c("_w") > 0) & (c("_from") < c("_to")))
    rows = docs.withColumn("row", F.explode(F.sequence(floor(c("_from") / c("_w")), floor((c("_to") - 1) / c("_w")))))
    # columns of the stream row this document covers
    rows = rows.withColumns({
        "_c0": F.greatest(c("_from") - c("row") * c("_w"), F.lit(0)), "_c1": F.least(c("_to") - c("row") * c("_w"), c("_w")),
        "_base": c("_from") - c("row") * c("_w"), "_last": floor((c("_w") - 2) / step),
    })
    first = F.greatest(floor((c("_c0") - 1) / step), F.lit(0))
    final = F.least(floor((c("_c1") - 1) / step) + n_context - 1, c("_last"))
    steps = rows.where(first <= final).withColumn("step", F.explode(F.sequence(first, final)))
    begin, end = c("step") * step, F.least(c("step") * step + step, c("_w") - 1)
    lo = F.greatest(c("_c0"), begin + step - l_max)
    t_lo = F.greatest(c("_c0"), begin + 1)
    parts = steps.select(
        "row", "step", (c("_base") + c("row") * c("_w")).alias("_at"),
        _part(arr, lo - c("_base"), F.least(c("_c1"), end) - c("_base")).alias("x"),
        _part(arr, t_lo - c("_base"), F.least(c("_c1"), end + 1) - c("_base")).alias("y"),
    )
    return parts.groupBy("row", "step").agg(_joined_parts("x").alias("input_ids"), _joined_parts("y").alias("target_ids"))


def pack_sentences(df: DataFrame, id_col: str, arr: str, l_max: int, streams: int, seed: int) -> DataFrame:
    """Sentences in seeded order packed into full rows of ``l_max`` tokens, in ``streams`` independent streams.

    A sentence gives its tokens but the last as inputs and its tokens but the first as targets; it may run on into the
    next row. Rows are (stream, row, ``input_ids``, ``target_ids``).
    """
    hashed = df.select(id_col, arr).where(F.size(arr) > 1).withColumn("_h", seeded_hash([id_col], seed))
    stream = (F.conv(F.substring("_h", 25, 8), 16, 10).cast("long") % streams).alias("stream")
    size = F.size(arr) - 1
    placed = _offsets(hashed.select("*", stream), ["stream"], ["_h", id_col], hash_slices("_h"), size)
    row = lambda at: F.floor(at / l_max).cast("long")
    cut = placed.withColumn("row", F.explode(F.sequence(row(F.col("_from")), row(F.col("_from") + size - 1))))
    lo = F.greatest(F.col("row") * l_max - F.col("_from"), F.lit(0))
    hi = F.least((F.col("row") + 1) * l_max - F.col("_from"), size)
    parts = cut.select("stream", "row", F.col("_from").alias("_at"), _part(arr, lo, hi).alias("x"), _part(arr, lo + 1, hi + 1).alias("y"))
    out = parts.groupBy("stream", "row").agg(_joined_parts("x").alias("input_ids"), _joined_parts("y").alias("target_ids"))
    return out.where(F.size("input_ids") == l_max)
