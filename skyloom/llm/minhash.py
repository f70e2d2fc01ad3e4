"""MinHash near-deduplication by an inverted join over signature coordinates.

Documents with the same set of 3-word shingles are one class from the start. Each class has a MinHash signature, and is
posted under every pair of coordinate and value. Two sets of similarity 0.85 agree in ``MATCHES`` of ``COORDINATES``
coordinates but for a chance of 5e-7, so a pair that agrees in fewer is not looked at. Postings are rare first: values
that only one class has come before all others, a class without ``MATCHES`` shared values is skipped, and of the rest
only the prefix is posted in which any such pair has to meet. Lists with the same members are merged to one.

Within a list collisions are counted against whole signatures; what agrees often enough is a cluster. Its members' texts
meet once, and the exact similarity of their whole shingle sets (64-bit hashes) decides the links. Lists and clusters of
any size are cut into blocks, see ``group_links``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.common import stored, stored_small
from skyloom.llm.components import components
from skyloom.llm.group_links import grown, links_in_groups
from skyloom.llm.shingle_sets import by_bytes, shingle_sets, signatures
from skyloom.skew import join_counted

SHINGLE = 3
SIMILARITY = (85, 100)  # as a fraction
COORDINATES, MATCHES = 32, 16
LIST_BLOCK = 4_000  # signatures of a list compared in one task
CLUSTER_BLOCK = 2_000_000  # shingles of a cluster compared in one task


def _digests(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, by which equal sets are told; none for an empty set."""
    import xxhash

    ends = np.cumsum(counts).tolist()
    return [xxhash.xxh3_128_digest(values[lo:hi].tobytes()) if hi > lo else None for lo, hi in zip([0, *ends], ends)]


def shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, key, tokens`` of every row: size and digest of its shingle set, one number per coordinate and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in by_bytes(batch.column(1)):
                values, counts = shingle_sets(texts, SHINGLE)
                tokens = signatures(values, counts, COORDINATES).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(counts > 0, COORDINATES, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel()))
                yield pa.record_batch(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(_digests(values, counts), pa.binary()), lists],
                    names=["id", "n", "key", "tokens"],
                )

    return rows_of(docs, id_col, text_col).mapInArrow(run, "id long, n long, key binary, tokens array<long>")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))


def by_signature(matches: int):
    """Linker: signatures that agree in ``matches`` coordinates."""

    def link(values: pa.Array) -> Iterator[tuple[int, int]]:
        rows = values.flatten().to_numpy().reshape(len(values), -1)
        return grown(len(rows), lambda x, others: (rows[others] == rows[x]).sum(axis=1) >= matches)

    return link


def by_sets(length: int, similarity: tuple[int, int], keyed: bool = True):
    """Linker of texts by their whole sets of shingles. With ``keyed``, the digest of the set (16 bytes) stands before each
    text, and a text of another digest is linked with nothing."""
    top, bottom = similarity
    lead = 16 if keyed else 0

    def link(values: pa.Array) -> Iterator[tuple[int, int]]:
        import xxhash

        all_values, counts = [], []
        for _, part in by_bytes(values):
            v, c = shingle_sets([p[lead:] for p in part], length)
            all_values.append(v)
            counts.append(c)
        flat, sizes = np.concatenate(all_values), np.concatenate(counts)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        right = np.ones(len(sizes), bool) if not keyed else np.array([xxhash.xxh3_128_digest(flat[lo:hi].tobytes()) == v.as_py()[:16] for lo, hi, v in zip(starts.tolist(), ends.tolist(), values)])
        flat = np.unique(flat, return_inverse=True)[1]
        here = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(others), bool)
            if not right[x]:
                return hit
            small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
            fit = np.flatnonzero(right[others] & (small * bottom >= large * top))  # sets of such sizes only
            if not len(fit):
                return hit
            at, n = starts[others[fit]], sizes[others[fit]]
            here[flat[starts[x] : ends[x]]] = True
            first = np.cumsum(n) - n
            both = np.add.reduceat(here[flat[np.repeat(at - first, n) + np.arange(int(n.sum()))]], first, dtype=np.int64)
            here[flat[starts[x] : ends[x]]] = False
            hit[fit] = both * bottom >= top * (sizes[x] + n - both)
            return hit

        return grown(len(sizes), near)

    return link


def posting_lists(classes: DataFrame, matches: int) -> DataFrame:
    """``group, node, size``: lists of at least two classes, such that classes that agree in ``matches`` values share one.

    ``classes``: stored ``node`` and ``tokens``.
    """
    posted = classes.select(F.explode("tokens").alias("token"), "node")
    shared = stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    entry = F.struct("n", "token")  # rare first, the same order everywhere
    held = join_counted(posted, shared.select("token", "n", F.col("n").alias("copies")), ["token"], "copies")
    prefix = held.groupBy("node").agg(F.sort_array(F.collect_list(entry)).alias("held")).where(F.size("held") >= matches)
    # all values that no other class has come first: of the shared ones, so many still belong to the prefix
    prefix = prefix.select("node", F.explode(F.slice("held", F.lit(1), F.size("held") - (matches - 1))).alias("e"))
    prefix = stored(prefix.select(F.col("e.token").alias("group"), "node"))
    mix = F.xxhash64("node")
    lists = prefix.groupBy("group").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(mix).alias("m1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("m2")
    ).where("size > 1")
    lists = lists.groupBy("size", "m1", "m2").agg(F.min("group").alias("group")).select("group", "size", F.col("size").alias("copies"))
    return join_counted(prefix, stored(lists), ["group"], "copies")


def clustered(classes: DataFrame, matches: int, block: int) -> DataFrame:
    """``node, cluster`` of all classes that agree with another one, over any number of steps, in ``matches`` values."""
    lists = stored(posting_lists(classes, matches))
    members = lists.join(classes.select("node", F.col("tokens").alias("value")), "node")
    roots = components(links_in_groups(members, by_signature(matches), block))
    return roots.select("node", F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, matches: int = MATCHES,
    list_block: int = LIST_BLOCK, cluster_block: int = CLUSTER_BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` (smallest id linked to it), ``kept``.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows are judged each and fall together by
    their text. A row with a null id counts for its set, joins a component only if a row with an id has the same set, and
    is never kept. Ids are integers; other columns are ignored; an empty table gives an empty result.
    """
    found = stored(shingled(docs, id_col, text_col))
    classes = found.where("n > 0").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("tokens").alias("tokens"), F.any_value("n").alias("n")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    clusters = stored(clustered(classes.where("id IS NOT NULL"), matches, list_block))
    wanted = stored(clusters.join(classes.select("node", "id", "key", "n"), "node"))
    sizes = stored(wanted.groupBy("cluster").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("copies")))
    wanted = join_counted(wanted, sizes, ["cluster"], "copies").select("id", "key", "node", "cluster", "size")
    texts = rows_of(docs, id_col, text_col).join(wanted, "id")
    members = stored_small(texts.select(F.col("cluster").alias("group"), "node", "size", F.concat("key", "text").alias("value")))
    roots = components(links_in_groups(members, by_sets(SHINGLE, similarity), cluster_block))

    named = stored(classes.select("key", "id", "copies", "node").join(roots, "node", "left").select("key", "id", "copies", F.coalesce("root", "node").alias("group")))
    firsts = stored(named.groupBy("group").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_class = stored(join_counted(named.select("group", "key", "copies"), firsts, ["group"], "n").select("key", "copies", "component_id"))
    placed = join_counted(found.where("n > 0").select("id", "n", "key"), of_class, ["key"], "copies")
    placed = placed.select("id", "n", "component_id").unionByName(found.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
