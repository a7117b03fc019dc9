"""The prefix trie of conversations, by Patricia construction.

A conversation is a sequence of (role, text) turns; each distinct sequence of first turns is a node. Sequences are written
as chains of digests (a turn's digest hashed with the chain before it), sorted by their chains over range partitions, and
compared with their neighbours: the common prefix of two neighbours ends at a branch point or at the end of one of them.
Those points and the ends (leaves among them) are the compressed tree; between two of them lies an edge of nodes with one
child each and the same members, which are not created.

Aggregates are of the compressed tree alone. A point belongs to its smallest member, so every conversation owns the lower
part of its path. What a subtree sums up is then what its members own, less what the owner of its top owns above it: one
aggregation, no walk over levels. Last, edges are unfolded to nodes by the suffix sums of their texts' lengths.

Equal conversations are one sequence. Their ids are joined range by range before they meet, and the hash over them runs
along those pieces in order, so a conversation that a third of the ids repeat is as many rows as there are ranges. The
digests of one conversation (some 24 bytes a turn) are one row.

Defined results: rows without a conv_id take no part; turns are ordered by turn, null first, equal ones by digest; a null
role or text is empty; an empty table gives an empty table; other columns are ignored. Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Bytes of a digest, and ids that a piece of an equal group's list holds at most.
KEY, PIECE = 16, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (digest, and code points of the text) in their order."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("chars")).filter("conv_id IS NOT NULL")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def with_shared_starts(own: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Sequences whose first h turns (by a hash of the id, `most` at the most) are those of the first conversation of their
    block of ids; the remainder is SQL's, so ids below zero count towards zero."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    first = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("lead"))
    both = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % block).join(first, "head", "left").withColumn("h", h.cast("int"))
    lead = F.when(F.col("lead").isNotNull() & (F.col("h") > 0), F.slice("lead", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(lead, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _chained(own: DataFrame) -> DataFrame:
    """conv_id, path (the chain's digests) and upto (code points of the first turns, from none to all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = b.column("turns")
            flat, sizes = turns.flatten(), np.asarray(turns.value_lengths(), dtype=np.int64)
            digests, chars = flat.field("digest").to_pylist(), np.asarray(flat.field("chars"), dtype=np.int64)
            paths, sums, k = [], [], 0
            for n in sizes.tolist():
                key, path = b"", []
                for d in digests[k : k + n]:
                    key = hashlib.blake2b(key + d, digest_size=KEY).digest()
                    path.append(key)
                paths.append(b"".join(path))
                sums.append(np.concatenate([[0], np.cumsum(chars[k : k + n])]).astype(np.int64))
                k += n
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(paths, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], ["conv_id", "path", "upto"])

    return own.mapInArrow(run, "conv_id long, path binary, upto array<long>")


def _common(a: bytes, b: bytes) -> int:
    """How many digests two paths have in common; a digest stands for all before it, so halving finds the last."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[(mid - 1) * KEY : mid * KEY] == b[(mid - 1) * KEY : mid * KEY] else (low, mid - 1)
    return low


_PIECES = "edge boolean, part int, no int, path binary, upto array<long>, n long, sid long, ids string, shared int, last binary"


def _sorted_pieces(chained: DataFrame) -> DataFrame:
    """The sorted sequences, equal ones in pieces: their number, smallest and joined ids, and what they share with the
    sequence before. And of every range an `edge` row with its first and its last path."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    shape = pa.schema([("edge", pa.bool_()), ("part", pa.int32()), ("no", pa.int32()), ("path", pa.binary()), ("upto", pa.list_(pa.int64())), ("n", pa.int64()), ("sid", pa.int64()), ("ids", pa.string()), ("shared", pa.int32()), ("last", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        first: bytes | None = None
        path: bytes | None = None
        upto: list[int] = []
        ids: list[int] = []
        shared = -1
        rows: list[tuple] = []
        for b in batches:
            for c, p, u in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist(), b.column("upto").to_pylist()):
                if path is None or p != path or len(ids) == PIECE:
                    if path is not None:
                        rows.append((False, part, no, path, upto, len(ids), ids[0], ",".join(map(str, ids)), shared, None))
                        no += 1
                    shared = -1 if path is None or p == path else _common(path, p)
                    first, path, upto, ids = p if first is None else first, p, u, []
                ids.append(c)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)
                rows = []
        if path is not None:
            rows = [(False, part, no, path, upto, len(ids), ids[0], ",".join(map(str, ids)), shared, None), (True, part, no, first, [], 0, 0, "", -1, path)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)

    n = int(chained.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(chained.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, _PIECES))


def _last_key(path: str = "path") -> Column:
    return F.substring(path, -KEY, KEY)


def _distinct(pieces: DataFrame) -> DataFrame:
    """sid (its smallest id), key, depth, path, upto, n and ends_sha256 of every distinct sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        shape = pa.schema([("sid", pa.int64()), ("path", pa.binary()), ("upto", pa.list_(pa.int64())), ("n", pa.int64()), ("ends_sha256", pa.string())])
        out: list[list] = []

        def done(x: list) -> list:
            return [*x[:4], x[4].hexdigest()]

        for b in batches:
            for p, u, n, sid, ids in zip(*(b.column(c).to_pylist() for c in ("path", "upto", "n", "sid", "ids"))):
                if now is not None and now[1] == p:
                    now[3] += n
                    now[4].update(b"," + ids.encode())
                else:
                    out += [done(now)] if now is not None else []
                    now = [sid, p, u, n, hashlib.sha256(ids.encode())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), shape)], schema=shape)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(now), shape)], schema=shape)

    rows = pieces.filter("NOT edge").select(_last_key().alias("key"), "part", "no", "path", "upto", "n", "sid", "ids")
    merged = rows.repartition("key").sortWithinPartitions("key", "part", "no").drop("key", "part", "no").mapInArrow(run, "sid long, path binary, upto array<long>, n long, ends_sha256 string")
    return stash(merged.select("sid", _last_key().alias("key"), (F.octet_length("path") / KEY).cast("int").alias("depth"), "path", "upto", "n", "ends_sha256"))


def _points(pieces: DataFrame, distinct: DataFrame) -> DataFrame:
    """The keys of all branch, end and leaf points but the root: where neighbours part, and where sequences end."""
    within = pieces.filter("NOT edge AND shared > 0").select(F.substring("path", KEY * F.col("shared") - (KEY - 1), F.lit(KEY)).alias("key"))
    # one row of two paths for each range, in the order of the ranges
    before = F.lag("last").over(Window.orderBy("part"))
    pairs = pieces.filter("edge").select("path", before.alias("before")).filter("before IS NOT NULL")
    at = lambda c, d: F.substring(c, KEY * d - (KEY - 1), F.lit(KEY))
    both = F.least(F.octet_length("path"), F.octet_length("before")) / KEY
    agree = F.filter(F.sequence(F.lit(1), F.greatest(both.cast("int"), F.lit(1))), lambda d: (d <= both) & (at(F.col("path"), d) == at(F.col("before"), d)))
    across = pairs.select(F.explode(F.slice(F.reverse(agree), 1, 1)).alias("d"), "path").select(at(F.col("path"), F.col("d")).alias("key"))
    ends = distinct.filter("depth > 0").select("key")
    return stash(within.union(across).union(ends).distinct())


def build(own: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. A node is named by its depth and the smallest id among its members."""
    pieces = _sorted_pieces(_chained(own))
    distinct = _distinct(pieces)
    points = _points(pieces, distinct)
    keys = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.substring("path", KEY * d - (KEY - 1), F.lit(KEY)))
    steps = distinct.filter("depth > 0").select("sid", F.posexplode(keys).alias("d", "key")).select("sid", (F.col("d") + 1).alias("d"), "key")
    on = steps.join(points, "key", "left_semi").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("d", "key"))).alias("way"))
    root = F.array(F.struct(F.lit(0).alias("d"), F.lit(b"").alias("key")))
    way = F.concat(root, F.coalesce("way", F.slice(root, 1, 0)))
    paths = stash(distinct.select("sid", "n").join(on, "sid", "left").select("sid", "n", way.alias("way")))

    # of every point the members' number, the owner, and the point above
    above = lambda x, i: F.struct(x["key"].alias("key"), x["d"].alias("d"), F.when(i > 0, F.get("way", i - 1)["d"]).otherwise(-1).alias("up"), F.when(i > 0, F.get("way", i - 1)["key"]).alias("up_key"))
    visits = paths.select("sid", "n", F.explode(F.transform("way", above)).alias("p"))
    tops = stash(visits.groupBy("p.key").agg(F.sum("n").alias("n_convs"), F.min("sid").alias("conv_id"), F.min("p.d").alias("d"), F.min("p.up").alias("up"), F.min("p.up_key").alias("up_key")))

    # what a sequence owns: its points with the code points that they and those below them save, and whether it ends as a leaf
    mine = tops.groupBy(F.col("conv_id").alias("sid")).agg(F.sort_array(F.collect_list(F.struct("d", "up", "key", "up_key", "n_convs"))).alias("own"))
    upto = lambda d: F.get("upto", d)
    saves = lambda e: (e["n_convs"] - 1) * F.when(e["d"] > 0, upto(e["d"]) - upto(F.greatest(e["up"], F.lit(0)))).otherwise(0)
    zero = F.lit(0).cast("long")
    saved = F.transform("own", saves)
    owned = distinct.select("sid", "n", "depth", "upto").join(mine, "sid").withColumn("saved", saved)
    last = F.element_at("own", -1)
    owned = owned.withColumn("total", F.aggregate("saved", zero, lambda a, x: a + x)).withColumn("leaf", ((last["d"] == F.col("depth")) & (last["n_convs"] == F.col("n"))).cast("long"))
    owned = stash(owned)
    weights = paths.join(owned.select("sid", "total", "leaf"), "sid", "left").select(F.explode("way.key").alias("key"), F.coalesce("total", zero).alias("total"), F.coalesce("leaf", zero).alias("leaf"))
    sums = weights.groupBy("key").agg(F.sum("total").alias("all_saved"), F.sum("leaf").alias("n_leaves"))

    # edges with the suffix sums of their nodes' code points, and what the owner's points below save
    chars = lambda e: F.transform(F.sequence(e["up"] + 1, e["d"]), lambda x: F.when(x > 0, upto(e["d"]) - upto(x - 1)).otherwise(0))
    below = lambda i: F.aggregate(F.slice("saved", i + 2, F.size("saved")), zero, lambda a, x: a + x)
    listed = owned.select(F.col("sid").alias("conv_id"), "total", F.explode(F.transform("own", lambda e, i: F.struct(e["key"].alias("key"), e["up_key"].alias("up_key"), e["up"].alias("up"), e["d"].alias("d"), e["n_convs"].alias("n_convs"), chars(e).alias("chars"), below(i).alias("below")))).alias("e"))
    edges = listed.select("conv_id", "total", "e.*")
    children = tops.filter("up_key IS NOT NULL").groupBy(F.col("up_key").alias("key")).agg(F.count("*").alias("kids"))
    ends = distinct.select("key", "ends_sha256")
    full = edges.join(sums, "key").join(children, "key", "left").join(ends, "key", "left")
    over = stash(tops.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up_conv")))
    full = full.join(over, "up_key", "left")
    nodes = full.select("*", F.posexplode("chars").alias("i", "rest"))
    top, bottom = F.col("i") == 0, F.col("up") + 1 + F.col("i") == F.col("d")
    return nodes.select(
        "conv_id",
        (F.col("up") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(top, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n_convs").cast("long").alias("n_convs"),
        F.when(bottom, F.coalesce("kids", zero)).otherwise(1).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("all_saved") - F.col("total") + F.col("below") + (F.col("n_convs") - 1) * F.col("rest")).cast("long").alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return build(sequences(conversations))


def query(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared starts."""
    return build(with_shared_starts(sequences(conversations)))


_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)) + z)), 4294967295::BIGINT)"
ORACLE = f"""
WITH o AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
g AS (SELECT c, ts, CAST({_CRC} % 6 AS INTEGER) AS h FROM o),
b AS (SELECT g.c, list_concat(coalesce(f.ts[1:g.h], []), g.ts[g.h + 1:]) AS ts FROM g LEFT JOIN o f ON f.c = g.c - g.c % 100),
p AS (SELECT c, len(ts) AS n, ts, unnest(range(0, len(ts) + 1)) AS d FROM b),
n AS (SELECT ts[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY 1, 2),
u AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(u.kids, 0) AS kids, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.k[d].t) ELSE 0 END AS saved FROM n LEFT JOIN u ON n.k = u.k),
x AS (SELECT k, saved, kids, unnest(range(0, d + 1)) AS a FROM m),
s AS (SELECT k[1:a] AS k, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM x GROUP BY 1)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON m.k = s.k LEFT JOIN m up ON m.d > 0 AND up.k = m.k[1:m.d - 1]
"""
