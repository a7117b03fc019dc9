import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import common, quality, simhash


def test_hot_keys_are_broadcast_and_no_row_is_lost(spark):
    held = [(k, i) for k, n in ((1, 200), (2, 65), (3, 64), (4, 1)) for i in range(n)]
    rows = spark.createDataFrame(held, "k long, i long")
    table = spark.createDataFrame([(1, 10, 200), (2, 20, 65), (3, 30, 64), (4, 40, 1), (5, 50, 0)], "k long, x long, n long")
    out = common.spread(rows, table, "k", len(held))
    assert sorted(map(tuple, out.select("k", "i", "x").collect())) == sorted((k, i, 10 * k) for k, i in held)
    assert "n" not in out.columns
    assert not common.spread(rows.limit(0), table, "k", 0).collect()


def test_roots_of_a_hub(spark):
    # a hub in the middle of the order, a chain through it, and a component of its own
    edges = [(500, k) for k in range(1, 400)] + [(500, k) for k in range(600, 700)] + [(k, k + 1) for k in range(1000, 1010)]
    got = dict(map(tuple, simhash.roots(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {v: (1 if v < 1000 else 1000) for e in edges for v in e if v not in (1, 1000)}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_batches_of_the_pipeline_are_bounded_by_bytes(spark, monkeypatch):
    most = 5 << 20
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("x"), 20_000)).alias("text"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    held = lambda texts: sum(len(t or "") for t in texts)
    real = quality.expectation

    def expectation(model, texts, reach):
        assert held(texts) <= most
        return real(model, texts, reach)

    monkeypatch.setattr(quality, "expectation", expectation)
    assert quality.select(docs, labels).count() == 1500

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    got = common.in_arrow(docs, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 1500 and max(r["bytes"] for r in got) <= most

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 20))  # a bound that the session has stands
    try:
        assert max(r["bytes"] for r in common.in_arrow(docs, sizes, "rows long, bytes long").collect()) <= 2 << 20
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.set(key, before)
