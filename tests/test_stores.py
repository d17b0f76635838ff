import random

from conftest import rows_of
from pyspark.sql import functions as F

from trendloom.functions.tables import written
from trendloom.streaming.stores import KeyedStore


def test_lookups_find_every_key_and_read_few_other_rows(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    store = KeyedStore(spark, str(tmp_path), ["k"], schema, bucket_rows=20, fold=3)
    rnd, held, read = random.Random(8), {}, []
    for batch in range(9):
        rows = [(f"key{rnd.randrange(10**6)}", batch) for _ in range(150)] + [(None, batch)]
        wanted = rnd.sample(sorted(k for k in held if k), 5) + ["absent"] if held else ["absent"]
        found = store.lookup(spark.createDataFrame([(k,) for k in wanted], "k string"), batch)
        got = rows_of(found.where(F.col("k").isin(wanted)), "k", "v")
        assert got == sorted((k, v) for k in wanted if k in held for v in held[k])
        read.append(found.count())
        store.put(written(spark.createDataFrame(rows, schema), "rows"), batch)
        for k, v in rows:
            held.setdefault(k, []).append(v)
    assert max(read[6:]) < 700 < store.content().count() == 9 * 151  # six keys of a store of 1,359 rows
    assert len(store.segments()) <= 4 and len(store.segments(5)) >= 2
    assert store.content().where("k IS NULL").count() == 9
    before = store.content().count()
    assert len(store.vacuum()) > 0 and store.content().count() == before


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    store = KeyedStore(spark, str(tmp_path), ["k"], schema)
    put = lambda rows, batch: store.put(spark.createDataFrame(rows, schema), batch)
    assert store.content().count() == 0 and store.lookup(spark.createDataFrame([("a",)], "k string"), 0).count() == 0
    put([("a", 1)], 0)
    put([("b", 2), ("c", 3)], 1)
    put([("b", 2)], 1)
    put([], 2)
    assert rows_of(store.content(), "k", "v") == [("a", 1), ("b", 2)]
    assert store.lookup(spark.createDataFrame([("b",)], "k string"), 1).where("k = 'b'").count() == 0


def test_rows_put_with_a_bound_are_read_once(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    store, read = KeyedStore(spark, str(tmp_path), ["k"], schema), spark.sparkContext.accumulator(0)

    def counted(v):
        read.add(1)
        return v

    rows = spark.range(30).select(F.col("id").cast("string").alias("k"), F.udf(counted, "long")("id").alias("v"))
    store.put(rows, 0, most=50)
    assert read.value == 30 and [s["rows"] for s in store.segments()] == [30]
    store.put(rows.where("k = 'absent'"), 1, most=50)
    assert len(store.segments()) == 1 and store.content().agg(F.sum("v")).first()[0] == sum(range(30))
