"""Packing documents into sequences of fixed length by cutting stock.

Documents are encoded once. What is longer than a sequence is cut into whole sequences first. The rests are counted per
length class (rounded down), a cutting-stock program over that histogram, whose size does not depend on the data, gives
patterns of classes that fill a sequence, and the documents of each class, ranked, take their places in the patterns. As
classes round down, a sequence comes out full or a little over; the overhang of its last document, the shortest rests and
the documents that no pattern takes form one stream that is cut at sequence ends. The stream's last part is cut into
powers of two, which need no padding.

Ranks and running sums are prefix sums over the parts of the stored token table, so no class has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyloom.llm.common import stored, stored_small
from skyloom.llm.cutting_stock import plan
from skyloom.llm.shingle_sets import by_bytes
from skyloom.llm.word_bpe import encoder
from skyloom.slicing import running_total, with_ordinal

LENGTH = 4096
CLASS = 16  # tokens per length class
LEAST_FILL = 0.995
EOS = 2


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, eos: int = EOS) -> DataFrame:
    """``row`` (unique), ``id``, ``ids`` (little-endian, four bytes each), ``n`` (with ``eos``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end, width = np.array([eos], coder.dtype).tobytes(), np.dtype(coder.dtype).itemsize
        for batch in batches:
            for first, texts in by_bytes(batch.column(2)):
                ids = [coder.encode(t) + end for t in texts]
                sizes = np.array([len(x) // width for x in ids], np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes * 4)))
                if ends[-1] >= 1 << 31:
                    raise ValueError("a text of over 536,870,911 tokens does not fit a row")
                flat = np.frombuffer(b"".join(ids), coder.dtype).astype("<u4")
                lists = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                own = [batch.column(k).slice(first, len(texts)) for k in range(2)]
                yield pa.record_batch([*own, lists, pa.array(sizes)], names=["row", "id", "ids", "n"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, ids binary, n long")


def _part(row: str = "row"):
    """The task that numbered the row: grows with ``row``, and its rows were one task's once."""
    return F.call_function("shiftright", F.col(row), F.lit(33))


def _places(patterns: list[tuple[np.ndarray, int]]) -> tuple[list[tuple], int]:
    """For each class the ranks that a pattern takes: (class, from, to, first sequence, places per sequence)."""
    out, taken, sequence = [], {}, 0
    for counts, times in patterns:
        for k in np.flatnonzero(counts):
            n, size = int(counts[k]), int(k) + 1
            lo = taken.get(size, 0)
            out.append((size, lo, lo + n * times, sequence, n))
            taken[size] = lo + n * times
        sequence += times
    return out, sequence


def _cut_stream(stream: DataFrame, first: int, length: int) -> tuple[DataFrame, int]:
    """Pieces of a stream of (row, start, size): cut at sequence ends, its last part at powers of two."""
    placed = running_total(
        stream, [], ["row", "start"], [F.call_function("shiftright", _part(), F.lit(10)), _part()], {"pos": F.col("size")}, inclusive=False
    ).withColumn("pos", F.col("pos").cast("long"))
    total = stream.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    whole = total // length * length
    ends, at = [], whole
    for k in range(length.bit_length(), -1, -1):
        if (total - whole) >> k & 1:
            at += 1 << k
            ends.append(at)
    starts = F.array(*[F.lit(p).cast("long") for p in [whole, *ends[:-1]]])  # of the sequences of the last part
    inside = lambda p: (p > F.col("pos")) & (p < F.col("pos") + F.col("size"))
    step = F.lit(length).cast("long")
    next_end = (F.floor(F.col("pos") / step) + 1) * step
    last_end = F.floor((F.col("pos") + F.col("size")) / step) * step
    grid = F.when(next_end <= last_end, F.sequence(next_end, F.greatest(next_end, last_end), step)).otherwise(F.array().cast("array<long>"))
    points = F.array_sort(F.array_distinct(F.concat(F.filter(grid, lambda p: p <= whole), starts)))
    cuts = F.concat(F.array("pos"), F.filter(points, inside), F.array(F.col("pos") + F.col("size")))
    pieces = placed.select("row", "start", "pos", cuts.alias("cuts")).select(
        "row", F.explode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(
            (F.col("start") + F.get("cuts", i - 1) - F.col("pos")).alias("start"),
            (F.get("cuts", i) - F.get("cuts", i - 1)).alias("length"),
            F.get("cuts", i - 1).alias("pos"),
        ))).alias("p")
    ).select("row", "p.*")
    begun = F.filter(starts, lambda s: s <= F.col("pos"))
    late = F.col("pos") >= whole
    return pieces.select(
        "row", "start", "length",
        (F.lit(first) + F.when(late, F.lit(whole // length) + F.size(begun) - 1).otherwise(F.floor(F.col("pos") / step))).cast("long").alias("sequence"),
        F.when(late, F.col("pos") - F.array_max(begun)).otherwise(F.col("pos") % step).cast("long").alias("offset"),
    ), first + int(whole // length) + len(ends)


def pieces(sizes: DataFrame, length: int = LENGTH, width: int = CLASS, least_fill: float = LEAST_FILL) -> DataFrame:
    """``row, start, length, sequence, offset`` for a stored table of ``row`` and ``n``: every token in exactly one piece."""
    spark = sizes.sparkSession
    rests = sizes.select("row", "n", (F.col("n") % length).alias("rest")).withColumn("class", F.floor(F.col("rest") / width).cast("int"))
    counts = {r["class"]: r["count"] for r in rests.where("class > 0").groupBy("class").count().collect()}  # length / width rows
    demand = np.array([counts.get(k, 0) for k in range(1, length // width + 1)])
    segments, sequences = _places(plan(demand, length // width, least_fill))

    ranked = with_ordinal(rests.where("class > 0"), ["class"], ["row"], [_part()], "rank")
    kinds = pa.schema([("class", pa.int32()), *((c, pa.int64()) for c in ("lo", "hi", "first", "places"))])
    columns = [pa.array(x, f.type) for x, f in zip(zip(*segments), kinds)] or [pa.array([], f.type) for f in kinds]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds))  # rows of Python would take workers of their own
    at = F.col("rank") - 1
    joined = ranked.join(F.broadcast(table), (ranked["class"] == table["class"]) & (at >= F.col("lo")) & (at < F.col("hi")), "left")
    taken = stored(joined.select(
        "row", "n", "rest", ranked["class"].alias("class"), "rank", (F.col("first") + F.floor((at - F.col("lo")) / F.col("places"))).alias("sequence")
    ))
    order = Window.partitionBy("sequence").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("n") - F.col("rest")
    filled = taken.where("sequence IS NOT NULL").withColumn("offset", F.least(F.coalesce(F.sum("rest").over(order), F.lit(0)), F.lit(length)))
    filled = stored(filled.select("row", before.alias("start"), F.least("rest", F.lit(length) - F.col("offset")).alias("length"), "rest", "sequence", "offset"))
    kept = filled.where("length > 0").select("row", "start", "length", "sequence", "offset")

    over = filled.select("row", (F.col("start") + F.col("length")).alias("start"), (F.col("rest") - F.col("length")).alias("size"))
    untaken = taken.where("sequence IS NULL").select("row", before.alias("start"), F.col("rest").alias("size"))
    short = rests.where("class = 0").select("row", before.alias("start"), F.col("rest").alias("size"))
    stream = over.unionByName(untaken).unionByName(short).where("size > 0")
    streamed, sequences = _cut_stream(stored(stream), sequences, length)

    long = sizes.select("row", F.floor(F.col("n") / length).cast("long").alias("whole")).where("whole > 0")
    long = running_total(long, [], ["row"], [F.call_function("shiftright", _part(), F.lit(10)), _part()], {"before": F.col("whole")}, inclusive=False)
    whole = long.select("row", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k")).select(
        "row", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"),
        (F.lit(sequences) + F.col("before") + F.col("k")).cast("long").alias("sequence"), F.lit(0).cast("long").alias("offset"),
    )
    return kept.unionByName(streamed).unionByName(whole)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, width: int = CLASS) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers. Pieces of a sequence lie gapless from
    offset 0; a sequence has at most ``length`` tokens. Null and empty texts are the end token alone. Rows that repeat an
    id are packed each; null ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    if length & (length - 1) or length % width:
        raise ValueError("length is a power of two and a multiple of the class width")
    tokens = stored_small(encoded(docs, tokenizer, id_col, text_col))
    found = pieces(tokens.select("row", "n"), length, width)
    lists = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence", "offset")).alias("pieces"))
    cut = F.transform("pieces", lambda p: p.withField("ids", F.substring(F.col("ids"), (p["start"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))))
    out = tokens.join(lists, "row").select("id", "n", F.explode(cut).alias("p"))
    return out.select(
        F.col("id").alias(id_col), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), F.col("p.sequence").alias("sequence_id"), "p.offset"
    )
