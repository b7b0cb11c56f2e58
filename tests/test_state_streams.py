"""Streams with state that expires: equal to their batch twins, and empty once the clock has moved on."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftline.operators import state as S
from siftline.streaming import state as X

BEGIN = datetime(2024, 1, 1)


def run(spark, name, make, schema, files, tmp_path):
    """Each file is a micro-batch; the last one moves the clock on. Result rows, and how many rows of state are left."""
    X.prepared(spark)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    return spark.table(name).collect(), left


def test_limiter(spark, tmp_path):
    rnd = random.Random(2)
    schema = "bucket long, ts timestamp, hit_id long"
    hits = [(rnd.randrange(4), BEGIN + timedelta(milliseconds=100 * i), i) for i in range(120)]
    last = [(9, BEGIN + timedelta(days=1), 1000)]
    got, left = run(spark, "limiter", lambda s: X.limiter(s, 3, 5), schema, [hits[:50], hits[50:90], hits[90:], last, [(9, BEGIN + timedelta(days=2), 1001)]], tmp_path)
    want = S.rate_limit(spark.createDataFrame([*hits, *last, (9, BEGIN + timedelta(days=2), 1001)], schema), 3, 5).select("hit_id", "bucket", "request_count", "allowed", "remaining", "retry_after")
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want.collect()) and not all(r.allowed for r in got)
    assert max(left) == 5 and left[-1] == 1  # the windows of the four buckets are gone


CACHE = "event_id long, cache_key string, ts timestamp, kind string, payload string, version int, ttl long"


def test_cache(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"k{rnd.randrange(5)}", BEGIN + timedelta(seconds=i // 2), rnd.choice(["put", "get", "get"]), f"p{i}", rnd.randint(1, 2), rnd.choice([1, 4, 30])) for i in range(200)]
    last = [(1000, "other", BEGIN + timedelta(days=1), "get", None, 1, 0), (1001, "other", BEGIN + timedelta(days=2), "get", None, 1, 0)]
    got, left = run(spark, "cache", X.cache_stream, CACHE, [rows[:70], rows[70:140], rows[140:], last[:1], last[1:]], tmp_path)
    want = X.cache_reads(spark.createDataFrame(rows + last, CACHE)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and 20 < sum(r.hit for r in got) < len(got) and max(r.hit_count for r in got) > 1
    assert max(left) >= 5 and left[-1] == 0


def test_memo(spark, tmp_path):
    rnd = random.Random(4)
    schema = "event_id long, key string, ts timestamp, value string"
    rows = [(i, f"EN::q{rnd.randrange(14)}", BEGIN + timedelta(seconds=i), f"v{i}") for i in range(150)]
    last = [(1000, "x", BEGIN + timedelta(days=1), "v"), (1001, "x", BEGIN + timedelta(days=2), "w"), (1002, "x", BEGIN + timedelta(days=3), "w")]
    got, left = run(spark, "memo", lambda s: X.memo_stream(s, 20, most=6, shards=2), schema, [rows[:60], rows[60:], *([x] for x in last)], tmp_path)
    shard = {r.key: r.shard for r in spark.createDataFrame(rows + last, schema).select("key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("shard")).distinct().collect()}
    memo, want = {0: {}, 1: {}}, set()
    for i, key, ts, value in rows + last:
        own = memo[shard[key]]
        if key in own and own[key][1] > ts:
            want.add((i, True, own[key][0]))
            continue
        for k in [k for k, v in own.items() if v[1] <= ts]:
            del own[k]
        if len(own) >= 3:
            del own[next(iter(own))]
        own[key] = (value, ts + timedelta(seconds=20))
        want.add((i, False, value))
    assert {tuple(r) for r in got} == want and any(r.cached for r in got)
    assert left[-1] < max(left)
