"""Stores of keyed rows that a stream's batches extend, of which a batch reads only what its own keys can be in.

A store is a list of segments; a segment is a folder with one partition per hash bucket of the key, as many as its rows call for. A batch
adds a segment and reads, of each earlier one, the buckets of its keys. FOLD segments of one tier are merged into one of the next, so the
number of segments grows with the logarithm of the batches, and what a batch of given size reads with that alone. The list of live segments
is written last, one file per batch; a repeated batch starts from the list of the batch before it and replaces its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

FOLD = 8
BUCKET_ROWS = 20_000
MOST_BITS = 16


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, bucket_rows: int = BUCKET_ROWS, fold: int = FOLD):
        self.spark, self.path, self.keys, self.schema, self.bucket_rows, self.fold = spark, path, keys, schema, bucket_rows, fold

    def _folder(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _bucket(self, bits: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(1 << bits)).cast("int")

    def segments(self, before: int | None = None) -> list[dict]:
        """Live segments (name, tier, bits, rows) after the last batch, or after the last one below `before`."""
        fs, folder = self._folder(f"{self.path}/log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if not f.getPath().getName().startswith(("_", "."))) if fs.exists(folder) else []
        names = [n for n in names if before is None or int(n) < before]
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{names[-1]}").collect())) if names else []

    def _segment(self, s: dict) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/{s['name']}")

    def _read(self, segments: list[dict]) -> DataFrame:
        found = self.spark.createDataFrame([], self.schema)
        for s in segments:
            found = found.unionByName(self._segment(s).drop("bucket"))
        return found

    def content(self) -> DataFrame:
        return self._read(self.segments())

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Stored rows of all buckets that `keys` (the key columns) fall into: every row of those keys, and few others."""
        segments = self.segments(before)
        if not segments:
            return self._read([])
        bits = max(s["bits"] for s in segments)
        touched = [r[0] for r in keys.select(self._bucket(bits)).distinct().collect()]  # at most 2**MOST_BITS numbers
        found = self._read([])
        for s in segments:
            wanted = sorted({b & ((1 << s["bits"]) - 1) for b in touched})
            found = found.unionByName(self._segment(s).where(F.col("bucket").isin(wanted)).drop("bucket"))
        return found

    def _write(self, rows: DataFrame, name: str, tier: int, n: int) -> dict:
        bits = min(MOST_BITS, max(0, (n // self.bucket_rows).bit_length()))
        placed = rows.select(*self.schema.names, self._bucket(bits).alias("bucket"))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "tier": tier, "bits": bits, "rows": n}

    def put(self, rows: DataFrame, batch_id: int, most: int | None = None) -> None:
        """Append the rows of a batch. They are read once if the caller knows that they are `most` at most; else they are counted first,
        and must be cheap to read twice: a written table."""
        live = self.segments(batch_id)
        n = rows.count() if most is None else most
        if n:
            added = self._write(rows, f"segment={batch_id}-0", 0, n)
            added["rows"] = n if most is None else self._segment(added).count()
            live += [added] if added["rows"] else []
        tier = 0
        while len(same := [s for s in live if s["tier"] == tier]) >= self.fold:
            merged = self._write(self._read(same), f"segment={batch_id}-{tier + 1}", tier + 1, sum(s["rows"] for s in same))
            live, tier = [s for s in live if s["tier"] != tier] + [merged], tier + 1
        self.spark.createDataFrame([(json.dumps(live),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/log/{batch_id:012d}")

    def vacuum(self, keep_batches: int = 2) -> list[str]:
        """Delete segments that none of the last `keep_batches` lists names; gives their names."""
        fs, folder = self._folder(f"{self.path}/log")
        if not fs.exists(folder):
            return []
        last = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder))[-keep_batches:]
        live = {s["name"] for b in last for s in self.segments(b + 1)}
        _, top = self._folder(self.path)
        old = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("segment=") and f.getPath().getName() not in live]
        for path in old:
            fs.delete(path, True)
        return sorted(p.getName() for p in old)
