from pyspark.sql import functions as F

from sievemark.operators.snapshots import consecutive_snapshots, plain_hash, snapshot_changes

RUNS = "snapshot_id string, site string, recorded_at long, change string"
PAGES = "snapshot_id string, url string, content_hash string, pair string, record_key string"


def changes(spark, runs, pages):
    p = spark.createDataFrame([(*x, "x", "y") for x in pages], PAGES)
    pairs = consecutive_snapshots(spark.createDataFrame([(*r, "z") for r in runs], RUNS), p)
    return sorted(tuple(r) for r in snapshot_changes(p, pairs, "url", plain_hash(F.col("content_hash"))).collect())


def test_added_removed_changed(spark):
    runs = [("s2", "https://a/", 20), ("s1", "https://a", 10), ("s1", "https://a", 10), ("empty", "https://a", 15), ("s3", "https://a/", 30), ("t1", "https://b", 5), (None, "https://a", 1), ("q", None, 1)]
    pages = [
        ("s1", "u", "AB"), ("s1", "gone", "1"), ("s1", "n", None), ("s1", "twice", "1"), ("s1", "null", None), (None, "u", "1"), ("s1", None, "1"),
        ("s2", "u", "sha256:ab"), ("s2", "new", "2"), ("s2", "n", "0x1"), ("s2", "twice", "1"), ("s2", "twice", "1"), ("s2", "null", None), ("s2", "", "e"),
        ("s3", "u", "0xAC"), ("s3", "new", "2"), ("s3", "n", "1"), ("s3", "twice", "1"), ("s3", "twice", "2"), ("s3", "null", None), ("s3", "", "e"), ("t1", "u", "9"),
    ]
    assert changes(spark, runs, pages) == [("s2", "", "added"), ("s2", "gone", "removed"), ("s2", "n", "changed"), ("s2", "new", "added"), ("s3", "twice", "changed"), ("s3", "u", "changed")]


def test_empty(spark):
    assert changes(spark, [], []) == [] and changes(spark, [("s", "a", 1)], []) == []
