"""SentencePiece encoding by a relational lattice, and decoding.

Texts are split into chunks (see `pieces`) and the chunks are counted. For the frequent ones, at most HEAD_ROWS by a
threshold on the count, the lattice is a relation: every substring of bounded length is exploded, joined with the piece
table on equality (the vocabulary is of fixed size and broadcast), the edges are grouped by chunk, and Viterbi is a fold
over the edges in the order of their ends with the built-in `aggregate`. The solved chunks go to the tasks that encode
the texts; a task solves the chunks that are not among them by the same rules, so results don't depend on the threshold.
Chunks of over _LONG characters are always solved in the tasks, as the fold copies its nodes at every step.

Defined results: a null text has null tokens and decodes to null; an empty text has none and decodes to itself; decoding
gives the text again, except that a literal "▁" comes back as a space, as in the library; repeated rows are encoded
each; a null id is kept; an empty table gives an empty table; other columns are kept, one named tokens is replaced.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, in_arrow, stash
from .pieces import MODEL, SPACE, Table, decode_runs, encode_chunk, load, words

HEAD_ROWS = 200_000
_FLUSH = 200_000
_MEMO = 50_000
_LONG = 64


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, n) over all texts, pre-aggregated in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column("text"):
                seen.update(words(t.as_py()))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return in_arrow(docs.select(F.col(text).alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).select(F.concat(F.lit(SPACE), "word").alias("chunk"), "n")


def lattice(words: DataFrame, table: Table) -> DataFrame:
    """(chunk, ids): the best path of every distinct chunk of words."""
    spark = words.sparkSession
    # an Arrow table, as a list would pass through Python workers of another kind that stay beside those of mapInArrow
    columns = {"piece": pa.string(), "id": pa.int32(), "score": pa.float64()}
    pieces = spark.createDataFrame(pa.table([pa.array([p[k] for p in table.pieces], kind) for k, kind in enumerate(columns.values())], list(columns)))
    if len(table.pieces) <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    first = F.array(*[F.lit(i) for i in table.bytes])
    spans = words.select("chunk", F.char_length("chunk").alias("size")).select("chunk", "size", F.explode(F.expr("sequence(0, size - 1)")).alias("start"))
    spans = spans.select("chunk", "size", "start", F.explode(F.expr(f"sequence(1, least({table.longest}, size - start))")).alias("length"))
    spans = spans.withColumn("piece", F.substring("chunk", F.col("start") + 1, F.col("length")))
    edges = spans.join(pieces, "piece", "left").filter("id IS NOT NULL OR length = 1")
    raw = F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda i: F.element_at(first, F.conv(F.substring(F.hex("piece"), 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 1))
    edges = edges.select(
        "chunk", "size",
        F.struct((F.col("start") + F.col("length")).alias("end"), "start", F.coalesce("score", F.lit(table.unknown)).alias("score"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(raw).alias("ids")).alias("e"),
    )
    grouped = edges.groupBy("chunk", "size").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    node = lambda score, start, ids: F.struct(score.cast("double").alias("score"), start.cast("int").alias("start"), ids.cast("array<int>").alias("ids"))

    def step(nodes: Column, e: Column) -> Column:
        # nodes[p] is the best way to position p; edges come by end, then start, so only the last node can change
        score = F.get(nodes, e["start"])["score"] + e["score"]
        new = node(score, e["start"], e["ids"])
        return F.when(F.size(nodes) == e["end"], F.concat(nodes, F.array(new))).when(score > F.get(nodes, e["end"])["score"], F.concat(F.slice(nodes, F.lit(1), e["end"]), F.array(new))).otherwise(nodes)

    none = F.array().cast("array<int>")
    solved = grouped.withColumn("nodes", F.aggregate("edges", F.array(node(F.lit(0.0), F.lit(0), none)), step))

    def back(s: Column, _: Column) -> Column:
        last = F.get("nodes", s["at"])
        return F.when(s["at"] > 0, F.struct(last["start"].alias("at"), F.concat(last["ids"], s["ids"]).alias("ids"))).otherwise(s)

    path = F.aggregate(F.expr("sequence(1, size)"), F.struct(F.col("size").alias("at"), none.alias("ids")), back, lambda s: s["ids"])
    return solved.select("chunk", path.alias("ids"))


def head(docs: DataFrame, table: Table, rows: int = HEAD_ROWS, text: str = "text") -> tuple[list[str], bytes, np.ndarray]:
    """The solved frequent chunks, at most `rows`: chunks without their first SPACE, their ids end to end (32-bit), and where each ends."""
    counted = stash(chunk_counts(docs, text))
    sums = counted.agg(*[F.sum(F.when(F.col("n") >= (1 << k), 1).otherwise(0)).alias(f"k{k}") for k in range(1, 62)]).first()
    cut = next((1 << k for k in range(1, 62) if (sums[f"k{k}"] or 0) <= rows), 1 << 62)
    frequent = counted.filter((F.col("n") >= cut) & (F.char_length("chunk") <= _LONG)).select("chunk")
    found = lattice(frequent, table).toArrow()
    ids = found["ids"].combine_chunks()
    return [c[1:] for c in found["chunk"].to_pylist()], ids.flatten().to_numpy().astype(np.int32).tobytes(), ids.offsets.to_numpy()[1:] * 4


class _Solved(dict):
    """By chunk without its first SPACE, its ids as packed 32-bit integers: the frequent ones, and of the others those met last."""

    def __init__(self, table: Table, frequent: tuple[list[str], bytes, np.ndarray]) -> None:
        self.table, self.frequent, self.room = table, frequent, 0
        self._fill()

    def _fill(self) -> None:
        self.clear()
        names, flat, ends = self.frequent
        at = 0
        for name, end in zip(names, ends.tolist()):
            self[name] = flat[at:end]
            at = end
        self.room = _MEMO

    def __missing__(self, word: str) -> bytes:
        ids = array("i", encode_chunk(self.table, SPACE + word)).tobytes()
        if len(word) < _LONG:
            if not self.room:
                self._fill()
            self[word] = ids
            self.room -= 1
        return ids


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", rows: int = HEAD_ROWS, check: str | None = None) -> DataFrame:
    """docs with the column tokens, the ids of every whole text; and, if check names it, one with whether decoding them gives
    the text again, each text decoded as soon as it is encoded."""
    table = load(path)
    packed = docs.sparkSession.sparkContext.broadcast((table, head(docs, table, rows, text)))
    kept = docs.drop("tokens", *([check] if check else []))
    extra = [T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), *([T.StructField(check, T.BooleanType())] if check else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = _Solved(*packed.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                s = b.slice(at, 64)
                texts = s.column(text).to_pylist()
                parts = [None if t is None else b"".join(map(solved.__getitem__, words(t))) for t in texts]
                ends = np.cumsum([0, *(0 if p is None else len(p) // 4 for p in parts)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(p for p in parts if p), dtype=np.int32), pa.int32())
                missing = pa.array([p is None for p in parts], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(ends), flat, mask=missing)
                same = [pa.array([t is None or d == t.replace(SPACE, " ") for t, d in zip(texts, decode_runs(solved.table, flat, ends[1:]))], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*s.columns, ids, *same], [*s.schema.names, *(f.name for f in extra)])

    return in_arrow(kept, run, T.StructType([*kept.schema.fields, *extra]))


def decode(df: DataFrame, path: str = MODEL, tokens: str = "tokens", to: str = "decoded") -> DataFrame:
    """df with the column `to`, the text of the ids in `tokens`."""
    packed = df.sparkSession.sparkContext.broadcast(load(path))
    kept = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                s = b.slice(at, 64)
                ids = s.column(tokens)
                ends = np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))
                decoded = decode_runs(packed.value, ids.flatten(), ends)
                texts = pa.array([None if none else t for none, t in zip(ids.is_null().to_pylist(), decoded)], pa.string())
                yield pa.RecordBatch.from_arrays([*s.columns, texts], [*s.schema.names, to])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())]))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (of the ids, comma-joined) and round_trip (decoding gives the text again)."""
    both = encode(docs.select("doc_id", "text"), check="round_trip")
    return both.select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.sha2(F.array_join(F.coalesce("tokens", F.array().cast("array<int>")), ","), 256).alias("tokens_sha256"), "round_trip")
