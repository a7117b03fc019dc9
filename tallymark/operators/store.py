"""Output tables in buckets by key, changed bucket by bucket and switched all at once by one manifest.

Every table is laid out in the same number of buckets by a hash of its trimmed key, so a change rewrites only the buckets
that hold a changed key, of each table that it touches, in new folders beside the old ones. A manifest, one small numbered
file, says which folder each bucket of each table is in; its appearance is the change. Readers of an older manifest keep
their folders while it is among the last `keep`; a change that fails leaves no manifest, and so no trace for readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.text import strip

from .sink import KEY, replace_children, upsert
from .tables import kept


class Conflict(Exception):
    """Another writer has made the next manifest first; the change can be tried again."""


class Tables:
    """Tables (name to columns, all strings) under one folder. `buckets` is fixed when the folder is new: some 100 MB of rows each."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], key: str = KEY, buckets: int = 64, keep: int = 3) -> None:
        self.spark, self.path, self.columns, self.key, self.keep = spark, path.rstrip("/"), columns, key, keep
        self.buckets = self.manifest()[1].get("buckets", buckets)

    def _fs(self):
        jvm = self.spark._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make, make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        make, fs = self._fs()
        at = make(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """(number, content) of the manifest that counts, or of an older one; 0 and nothing before the first change."""
        have = self.versions()
        number = number or (have[-1] if have else 0)
        if not number:
            return 0, {}
        return number, json.loads(self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0])

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(strip(key), F.lit(""))), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, content: dict, only: list[int] | None = None) -> DataFrame:
        at = content.get("tables", {}).get(name, {})
        folders = [f for b, f in at.items() if only is None or int(b) in only]
        schema = ", ".join(f"`{c}` string" for c in self.columns[name])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as the last change left it, or as an earlier manifest that is still kept says."""
        return self._read(name, self.manifest(number)[1])

    def change(self, keys: DataFrame, changes: dict[str, Callable[[DataFrame], DataFrame]]) -> int:
        """Apply a change to each named table's rows in the buckets of keys; the new manifest's number.

        A change takes the present rows of those buckets and returns them as they should be; rows of other keys must stay
        as they are. Keys are only asked for their buckets, at most `buckets` numbers.
        """
        number, content = self.manifest()
        touched = sorted(r[0] for r in keys.select(self._bucket(F.col(f"`{self.key}`")).alias("b")).distinct().collect())
        if not touched:
            return number
        tables = {n: dict(content.get("tables", {}).get(n, {})) for n in self.columns}
        make, fs = self._fs()
        written: list[str] = []
        try:
            for name, change in changes.items():
                after = change(self._read(name, content, touched)).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in self.columns[name]])
                folder = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
                written.append(folder)
                after.withColumn("_bucket", self._bucket(F.col(f"`{self.key}`"))).repartition(min(len(touched), 1024), "_bucket").write.partitionBy("_bucket").parquet(folder)
                made = {int(s.getPath().getName().split("=")[1]): s.getPath().toString() for s in fs.listStatus(make(folder)) if "=" in s.getPath().getName()}
                if stray := set(made) - set(touched):
                    raise ValueError(f"a change of {name} made rows of other keys, in buckets {sorted(stray)}")
                for b in touched:
                    tables[name].pop(str(b), None)
                tables[name] |= {str(b): f for b, f in made.items()}
            self._publish(number + 1, {"buckets": self.buckets, "tables": tables})
        except Exception:
            for folder in written:
                fs.delete(make(folder), True)
            raise
        self._clean()
        return number + 1

    def _publish(self, number: int, content: dict) -> None:
        make, fs = self._fs()
        at = make(f"{self.path}/manifests/{number}.json")
        draft = make(f"{self.path}/manifests/{number}.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise Conflict(f"manifest {number} is there already")

    def _clean(self) -> None:
        """Drop manifests beyond the last `keep`, and the folders that none of the others names."""
        make, fs = self._fs()
        have = self.versions()
        old, live = have[: -self.keep], have[-self.keep :]
        if not old:
            return
        named = lambda numbers: {f for n in numbers for t in self.manifest(n)[1]["tables"].values() for f in t.values()}
        for folder in named(old) - named(live):
            fs.delete(make(folder), True)
        for n in old:
            fs.delete(make(f"{self.path}/manifests/{n}.json"), False)

    def write_submissions(self, facts: str, children: str, records: DataFrame, rows: DataFrame, roster: DataFrame | None = None) -> int:
        """Upsert the records and replace their rows, as one change. A record without a name takes the roster's (gid, name);
        of records with the same key (trimmed) the last by all columns stands, so the source need not have a key once."""
        if roster is not None:
            named = records.join(roster.select(F.col("gid").alias("_g"), F.col("name").alias("_n")), strip(F.col(f"`{self.key}`")) == strip(F.col("_g")), "left")
            records = named.withColumn("Name", F.when(F.coalesce("Name", F.lit("")) == "", F.coalesce("_n", F.lit(""))).otherwise(F.col("Name"))).select(*[F.col(f"`{c}`") for c in records.columns])
        whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
        once = kept(records.groupBy(strip(F.col(f"`{self.key}`")).alias("_key")).agg(F.max(whole).alias("_r")).select("_r.*"))
        return self.change(once, {facts: lambda now: upsert(now, once, self.key), children: lambda now: replace_children(now, once, rows, self.key)})
