from pathlib import Path

from pyspark.sql import functions as F

from echoloom.sources import store

FIELDS = "source_type string, source_id string, url string, title string, content string, author string, author_url string, timestamp timestamp_ntz, raw_metadata map<string,string>"


def batch(spark, *rows):
    """Records (key, title) of one source; the key also gives the url."""
    full = [("hn", key, f"u-{title}", title, f"text {title}", None, None, None, {"t": title}) for key, title in rows]
    return spark.createDataFrame(full, FIELDS).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))


def rows(df):
    return {r["source_id"]: (r["url"], r["title"]) for r in df.collect()}


def sizes(path, name):
    return sorted(p.name for p in (Path(path) / name).glob("*=*")) if (Path(path) / name).exists() else []


def test_batches_replay_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0 and store.version(spark, path) == -1
    store.compact(spark, path)
    first, second, third = batch(spark, ("a", "1"), ("b", "1"), ("b", "1"), (None, "x")), batch(spark, ("b", "2"), ("c", "2")), batch(spark, ("a", "3"))
    store.add_batch(first, path, 0, buckets=4)
    assert rows(store.read_store(spark, path)) == {"a": ("u-1", "1"), "b": ("u-1", "1")}
    for _ in range(2):  # the same batch again
        store.add_batch(second, path, 1, buckets=4)
    want = {"a": ("u-1", "1"), "b": ("u-1", "2"), "c": ("u-2", "2")}
    created = {r["source_id"]: r["created_at"] for r in store.read_store(spark, path).collect()}
    assert rows(store.read_store(spark, path)) == want
    store.compact(spark, path, buckets=2)  # another bucket count
    assert sizes(path, "delta") == [] and sizes(path, "base") == ["version=1"] and store.version(spark, path) == 1
    assert rows(store.read_store(spark, path)) == want
    store.add_batch(second, path, 1, buckets=16)  # a batch that comes again after it was compacted
    assert rows(store.read_store(spark, path)) == want
    store.add_batch(third, path, 2, buckets=16)
    want["a"] = ("u-1", "3")
    found = store.read_store(spark, path)
    assert rows(found) == want and {r["source_id"]: r["created_at"] for r in found.collect()} == created
    for key in ("a", "b", "nobody"):
        one = store.find(spark, path, "hn", key)
        assert rows(one) == ({key: want[key]} if key in want else {})
        assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_a_compaction_that_ended_half_way(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in range(3):
        store.add_batch(batch(spark, ("a", str(n)), (f"k{n}", "x")), path, n)
    want = rows(store.read_store(spark, path))
    store._written(batch(spark, ("junk", "junk")).select("*", F.lit("i").alias("id"), F.col("timestamp").alias("created_at"), F.col("timestamp").alias("updated_at")), f"{path}/base/version=2", 4)
    assert rows(store.read_store(spark, path)) == want  # no row in versions yet
    store.compact(spark, path)
    assert rows(store.read_store(spark, path)) == want and sizes(path, "base") == ["version=2"]


def test_batches_do_not_read_the_store(spark, tmp_path):
    path, add = str(tmp_path / "store"), store.store_batches(str(tmp_path / "store"), buckets=2, every=4)
    for n in range(9):
        add(batch(spark, ("a", str(n)), (f"k{n}", "x")), n)
    assert sizes(path, "delta") == ["batch=8"] and store.version(spark, path) == 7
    found = rows(store.read_store(spark, path))
    assert found["a"] == ("u-0", "8") and len(found) == 10
