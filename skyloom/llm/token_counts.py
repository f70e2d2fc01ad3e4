"""Token counts with a whole-token shortcut, for subword models of the sentencepiece BPE kind.

The text is cut before each run of spaces. Merges never cross such a cut if no vocabulary string has a space mark behind
another character; this is checked when the model is loaded. So the count of a text is the sum over its pre-tokens.

Which vocabulary strings encode alone as one token is proven once by encoding each of them: a string being in the
vocabulary is not enough, as merges of higher rank may cut it elsewhere. Pre-tokens among the proven strings count one;
only the rest is merged, and its counts are remembered per worker in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.word_bpe import worker_memory

MARK = "▁"  # how the model writes a space
REMEMBERED = 250_000  # merged pre-tokens kept per worker
LONGEST_KEPT = 48  # longer ones are merged each time
_RUNS = re.compile(" +[^ ]*")


class _Counts(dict):
    """Count by pre-token without its first space; misses are merged by the model."""

    def __init__(self, model, proven: dict[str, int]):
        super().__init__(proven)
        self.model, self.proven = model, proven

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word)) if word else 0
        if len(word) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n


class PieceCounter:
    """Counts tokens of whole texts exactly as ``encode`` of the model would give them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        probe = "  a \n\t b  "
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("this model merges across spaces or changes them: count its texts whole")
        self.proven = prove_single(self.model, pieces)
        self.counts = _Counts(self.model, self.proven)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")  # the model can't tell them apart
        get = self.counts.__getitem__
        if "  " in text or text[0] == " " or text[-1] == " ":
            # a pre-token keeps all spaces of its run; the model itself adds the first space of the text
            return sum(get(run[1:]) if run != " " else 1 for run in _RUNS.findall(" " + text))
        return sum(map(get, text.split(" ")))


def prove_single(model, pieces: list[str]) -> dict[str, int]:
    """Vocabulary strings that start a word and that the model, given them alone, encodes as that one token."""
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return {w: 1 for w, ids in zip(words, model.encode(words)) if len(ids) == 1 and model.id_to_piece(ids[0]) == MARK + w}


def counter(path: str) -> PieceCounter:
    known = worker_memory()
    if ("pieces", path) not in known:
        known["pieces", path] = PieceCounter(path)
    return known["pieces", path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Texts are read whole. Null and empty texts have no bytes and no tokens. Repeated rows give repeated results; other
    columns are ignored; a null id stays null. ``model_path`` has to exist on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            texts = batch.column(1)
            tokens = np.fromiter((count(t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
