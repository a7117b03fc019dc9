"""Token counts without tokens: an Aho-Corasick automaton finds the vocabulary's matches in each chunk of a text, and a
dynamic programme over their ends carries the best score and its piece count only, by the rules of `pieces`.

Chunks repeat, so each task keeps the counts of those it has seen, cleared at MEMO entries. Texts are never joined with
anything and nothing is shuffled.

Defined results: a null or empty text has 0 tokens; repeated rows are counted each; a null id is kept; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import MODEL, Table, best, chunks, load

MEMO = 400_000
_LONG = 64


class Counts(dict):
    """Piece counts by chunk; unseen chunks are solved, and kept if short."""

    def __init__(self, table: Table) -> None:
        self.table = table

    def __missing__(self, chunk: str) -> int:
        n = best(self.table, chunk)[1][-1]
        if len(chunk) <= _LONG:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = n
        return n


def count(docs: DataFrame, path: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row of docs."""
    packed = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(packed.value)
        for b in batches:
            n = [sum(map(known.__getitem__, chunks(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))
