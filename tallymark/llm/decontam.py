"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed, hashes are combined to k-grams by doubling (1, 2, 4, 8 words), and of every 6 consecutive 8-grams the
least is kept, so any shared span of 13 words shares a kept fingerprint. A hit is extended to the 13-word windows whose
least 8-gram it is, and these windows are compared word for word. Items shorter than a window are matched whole, by
hashes of their own length.

While the benchmark's fingerprints are within a counted bound, documents stream past them in one scan, and nothing but
hits and one row per document is shuffled. Beyond it, fingerprints meet in a shuffle join that carries no text (id, place,
length, hash); what met is written, and texts are joined to it by their own ids, once. Every document has a mark of its own
that needs no partner, so there is no key on which all documents meet. Equal lists of items are one row of a table, joined
once a document, so a passage that all items share is not repeated for each of its windows.

Defined results: null and empty texts have no words and are never contaminated; rows that repeat an id and text get equal
rows each; a null doc_id is kept; benchmark rows without id or words are no items; an empty benchmark hits nothing;
columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, light, small, stash

WINDOW = 13
GRAM = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _pairs(a: Column, b: Column, shift: int, n: Column, join) -> Column:
    """join(a[i], b[i + shift]) for every i with both, for arrays of at least n elements."""
    m = F.greatest(n - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(shift + 1), m), join)


def _grams(df: DataFrame, lengths: set[int]) -> DataFrame:
    """Adds n (words) and the arrays g1, g2, g4, g8 of k-gram hashes, and g<length> for the lengths asked for."""
    df = df.withColumn("n", F.size("words")).withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        df = df.withColumn(f"g{2 * k}", _pairs(F.col(f"g{k}"), F.col(f"g{k}"), k, F.size(f"g{k}"), lambda a, b: F.xxhash64(a, b)))
    for length in sorted(lengths):
        have = 0
        for k in (8, 4, 2, 1):
            if length & k:
                if not have:
                    df = df.withColumn("acc", F.col(f"g{k}"))
                else:
                    m = F.greatest(F.col("n") - (have + k - 1), F.lit(0))
                    df = df.withColumn("acc", F.zip_with(F.slice("acc", F.lit(1), m), F.slice(f"g{k}", F.lit(have + 1), m), lambda a, b: F.xxhash64(a, b)))
                have += k
        df = df.withColumnRenamed("acc", f"l{length}")
    return df


def _marks(df: DataFrame, short: set[int], window: int) -> DataFrame:
    """Adds least (the least gram of each window start) and marks: structs (j, len, fp) to look up.

    A run of equal minima is marked at its start and at every 6th position, so that each mark stands for at most 6
    window starts.
    """
    span = window - GRAM + 1
    df = _grams(df, short)
    low, have = F.col("g8"), 1
    df = df.withColumn("least", low)
    while have < span:
        step = min(have, span - have)
        df = df.withColumn("least", _pairs(F.col("least"), F.col("least"), step, F.size("least"), lambda a, b: F.least(a, b)))
        have += step
    starts = F.filter(
        F.transform("least", lambda x, i: F.struct(i.alias("j"), F.lit(window).alias("len"), x.alias("fp"))),
        lambda s: (s["j"] % span == 0) | (F.get("least", s["j"] - 1) != s["fp"]),
    )
    whole = [_whole(k) for k in sorted(short)]
    return df.withColumn("marks", F.concat(starts, *whole))


def _whole(length: int) -> Column:
    return F.transform(f"l{length}", lambda x, i: F.struct(i.alias("j"), F.lit(length).alias("len"), x.alias("fp")))


def _own_mark() -> Column:
    """A document's mark that finds no fingerprint, as no length is 0; its hash spreads over a shuffle as documents do."""
    return F.struct(F.lit(-1).alias("j"), F.lit(0).alias("len"), F.xxhash64("doc_id", "text_hash").alias("fp"))


def _streamed(rows: DataFrame, prints: DataFrame, short: set[int], window: int) -> DataFrame:
    """The marks of every row that meet the fingerprints, which are broadcast, and its own mark."""
    # explode_outer, as explode would add filters on the arrays and push copies of their whole expressions to the scan
    marked = _marks(rows.withColumn("words", words(F.col("text"))), short, window)
    marked = marked.select("doc_id", "text_hash", "words", "least", "n", F.col("n").alias("n_words"), F.explode_outer(F.concat(F.array(_own_mark()), "marks")).alias("m"))
    known = F.broadcast(prints.withColumn("known", F.lit(True)))
    return marked.select("doc_id", "text_hash", "words", "least", "n", "n_words", "m.*").join(known, ["len", "fp"], "left").filter("known or j < 0")


def _shuffled(rows: DataFrame, prints: DataFrame, short: set[int], window: int) -> DataFrame:
    """As _streamed, for fingerprints of any number: marks without texts are shuffled, then texts to their marks."""
    bare = _marks(rows.withColumn("words", words(F.col("text"))), short, window).select("doc_id", "text_hash", F.explode_outer("marks").alias("m"))
    met = stash(bare.select("doc_id", "text_hash", "m.*").join(prints, ["len", "fp"]).select("doc_id", "text_hash", "j", "len", "fp"))
    per = met.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).agg(F.collect_set(F.struct("j", "len", "fp")).alias("marks"))
    back = rows.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left")
    split = back.withColumn("all", words(F.col("text"))).withColumn("n_words", F.size("all"))
    # only texts with a mark need their grams again
    split = split.withColumn("words", F.when(F.col("marks").isNotNull(), F.col("all")).otherwise(F.slice("all", 1, 0)))
    found = F.concat(F.array(_own_mark()), F.coalesce("marks", F.array().cast("array<struct<j:int,len:int,fp:bigint>>")))
    again = _marks(split.withColumn("found", found).select("doc_id", "text_hash", "words", "n_words", "found"), set(), window)
    return again.select("doc_id", "text_hash", "words", "least", "n", "n_words", F.explode_outer("found").alias("m")).select("doc_id", "text_hash", "words", "least", "n", "n_words", "m.*")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, item_ids (sorted strings) and contaminated for every row of docs.

    limit: rows of a table (fingerprints, windows, lists of items) up to which it may be broadcast; results don't depend on it.
    """
    if not GRAM <= window:
        raise ValueError(f"window must be at least {GRAM}")
    span = window - GRAM + 1
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("words")).filter("item is not null and size(words) > 0").withColumn("n", F.size("words"))
    at = F.explode(F.expr(f"sequence(0, greatest(n - {window}, 0))")).alias("i")
    cut = F.slice("words", F.col("i") + 1, F.least(F.col("n"), F.lit(window)))
    windows = items.select("item", "words", "n", at).select("item", cut.alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = stash(windows.select("words", F.array_join("words", " ").alias("txt"), "items", F.sha2(F.to_json("items"), 256).alias("items_key")))
    lists = stash(windows.select("items_key", "items").dropDuplicates(["items_key"]))
    short = {r[0] for r in windows.select(F.size("words")).distinct().collect()} - {window}
    prints = stash(
        _marks(windows.select("words"), short, window)
        .select(F.col("n").alias("len"), F.explode_outer("marks").alias("m"))
        .filter("m.len = len")
        .select("m.len", "m.fp")
        .distinct()
    )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    found = (_streamed if prints.count() <= limit else _shuffled)(rows, prints, short, window)
    # a zero byte is in no word, so a document's own mark meets no window
    own = F.concat_ws("\0", F.lit(""), F.col("text_hash").cast("string"), F.col("doc_id").cast("string"))
    hit = lambda start, length: F.struct(start.alias("i"), length.alias("len"), F.array_join(F.slice("words", start + 1, length), " ").alias("txt"))
    around = F.filter(F.sequence("j", F.least(F.col("j") + (span - 1), F.col("n") - window)), lambda i: F.get("least", i) == F.col("fp"))
    tried = (
        F.when(F.col("len") == 0, F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("len"), own.alias("txt"))))
        .when(F.col("len") == window, F.transform(around, lambda i: hit(i, F.lit(window))))
        .otherwise(F.array(hit(F.col("j"), F.col("len"))))
    )
    exact = light(windows.select("txt", "items_key"), limit)
    tries = found.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.explode_outer(tried).alias("t")).select("doc_id", "text_hash", "n_words", "t.*")
    hits = tries.join(exact, "txt", "left").filter("items_key is not null or i < 0")
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["i"] + x["len"]).alias("end"),
            (s["n"] + F.greatest(x["i"] + x["len"] - F.greatest(s["end"], x["i"]), F.lit(0))).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )
    per = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("i") < 0, 1)).alias("copies"),
        F.collect_set(F.when(F.col("i") >= 0, F.struct("i", "len"))).alias("spans"),
        F.collect_set("items_key").alias("keys"),
    )
    # a document without hits gets a key of its own, so that such documents don't meet on one
    per = per.select("doc_id", "text_hash", "n_words", "copies", covered.alias("n_hit"), F.explode_outer("keys").alias("k")).withColumn("items_key", F.coalesce("k", own)).drop("k")
    named = per.join(light(lists, limit), "items_key", "left").groupBy("doc_id", "text_hash", "n_words", "copies", "n_hit")
    out = named.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "item_ids", "contaminated", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns. What is dropped is few, and found by id and text."""
    found = stash(contamination(docs, benchmark).filter("contaminated").select("doc_id", "text_hash").distinct())
    fresh = lambda name: next(n for n in (name + "_" * k for k in range(1, 1000)) if n not in docs.columns)
    a, b = fresh("id"), fresh("hash")
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(b))
    return docs.join(small(found.toDF(a, b), found.count()), same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return digest(contamination(docs, benchmark))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS t FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, ks),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i + 1, i + k), ' ') AS t FROM di),
h AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
