"""Identities, models and bounds of the sketches on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import guards, hashing, sizing
from tallyspark.operators import cardinality, folds, frequency, membership, quantiles, ranges, reconcile, sampling, similarity, static_filters, windows
from tallyspark.sources import codec, tables


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(3000).select((F.col("id") * 7).alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("few"), "id").cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sizing_and_guards():
    assert sizing.bloom_bits(100, 0.01) == 959
    assert sizing.bloom_probes(0.01) == 7
    assert sizing.count_min_shape(0.001, 0.01) == (2719, 5)
    assert math.isclose(sizing.zcdp_epsilon(sizing.zcdp_rho(1.0, 1e-6), 1e-6), 1.0)
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            guards.fraction("p", bad)
    with pytest.raises(ValueError):
        cardinality.HyperLogLog.sized(1000)


def test_hash_anchors():
    h = hashing.xxh3_64(bytes([0, 1, 2, 3]))
    assert (h & 0xFFFFFFFF, h >> 32) == (2776764914, 1624944694)


MERGED = [
    (membership.BloomFilter, "k", membership.BloomFilter.sized(3000, 0.01)), (membership.PartitionedBloomFilter, "k", membership.PartitionedBloomFilter.sized(3000, 0.01)),
    (membership.BloomFilter64, "k", membership.BloomFilter64.sized(3000, 0.01)), (membership.CountingBloomFilter, "few", membership.CountingBloomFilter.sized(50, 0.01)),
    (membership.DeletableBloomFilter, "k", membership.DeletableBloomFilter.sized(3000, 0.01, 40)), (membership.QuotientFilter, "few", membership.QuotientFilter.sized(3000, 0.01)),
    (cardinality.HyperLogLog, "k", cardinality.HyperLogLog.sized(256)), (cardinality.HyperLogLogPlus, "k", cardinality.HyperLogLogPlus.sized(8)),
    (cardinality.UltraLogLog, "k", cardinality.UltraLogLog.sized(8)), (cardinality.ThetaSketch, "k", cardinality.ThetaSketch.sized(4096)),
    (cardinality.ThetaSketch, "few", cardinality.ThetaSketch.sized(64)),
    (frequency.CountMinSketch, "few", frequency.CountMinSketch.sized(0.01, 0.01)), (frequency.CountSketch, "few", frequency.CountSketch.sized(0.1, 0.01)),
    (quantiles.DDSketch, "k", quantiles.DDSketch.sized(0.01)), (reconcile.InvertibleBloomLookupTable, "k", reconcile.InvertibleBloomLookupTable.sized(10)),
]


@pytest.mark.parametrize(("kind", "key", "spec"), MERGED, ids=lambda x: getattr(x, "KIND", ""))
def test_merge_is_the_sketch_of_the_union(keys, kind, key, spec):
    a, b = (kind.build(keys.where(F.col("id") % 2 == x), key, spec, ("g",)) for x in (0, 1))
    whole = kind.build(keys, key, spec, ("g",))
    assert same(a.merge(b).cells, whole.cells.select(a.merge(b).cells.columns))
    with pytest.raises(ValueError):
        a.merge(kind.build(keys, key, spec))


@pytest.mark.parametrize(("kind", "key", "spec"), MERGED, ids=lambda x: getattr(x, "KIND", ""))
def test_rollup_is_the_sketch_without_groups(keys, kind, key, spec):
    rolled = kind.build(keys, key, spec, ("g",)).rollup().cells
    assert same(rolled, kind.build(keys, key, spec).cells.select(rolled.columns))


def plain_theta(groups, k, theta=(1 << 64) - 1):
    """Sketches of sets of hashes, then their union, each trimmed by the rule."""
    def trimmed(hashes, low):
        kept = sorted(h for h in hashes if h < low)
        theta = kept[k] if len(kept) >= 2 * k else low
        return {h for h in kept if h < theta}, theta

    parts = [trimmed(g, theta) for g in groups]
    return trimmed(set().union(*(p for p, _ in parts)), min(t for _, t in parts))


@pytest.mark.parametrize("kind", [cardinality.ThetaSketch, cardinality.TupleSketch])
def test_trimmed_sketches_merge_as_sets(spark, kind):
    """Groups of 30 and 10,000 keys, k = 16: rollup, merge and window trim by the smaller theta."""
    df = spark.range(10_030).select("id", (F.col("id") >= 30).cast("long").alias("g"), F.lit(2.0).alias("value"))
    spec = kind.sized(16)
    hashes = {g: {int(r["h"]) for r in cardinality.ThetaSketch.hashed(df.where(F.col("g") == g), "id", spec).select("h").collect()} for g in (0, 1)}
    want, theta = plain_theta(hashes.values(), 16)
    grouped = kind.build(df, "id", spec, ("g",))
    a, b = (kind.build(df.where(F.col("g") == g), "id", spec) for g in (0, 1))
    window = windows.SlidingWindow(2, 2)
    shifted = kind(spec, grouped.cells.withColumnRenamed("g", "bucket"), ("bucket",))
    for made in (grouped.rollup(), a.merge(b), window.at(shifted, 1)):
        cells = made.cells.collect()
        assert {int(r["h"]) for r in cells} == want and {int(r["theta"]) for r in cells} == {theta}
    assert {int(r["h"]) for r in window.merged(shifted).cells.where("bucket = 1").collect()} == want
    if kind is cardinality.TupleSketch:
        assert math.isclose(grouped.rollup().total().first()[0], 2.0 * len(want) * ((1 << 64) - 1) / theta)


def test_counters_stick_when_rolled_up(spark):
    df = spark.range(60).select((F.col("id") % 2).alias("k"), (F.col("id") % 4).alias("g"))
    made = membership.CountingBloomFilter.build(df, "k", membership.CountingBloomFilter.sized(10, 0.01), ("g",)).rollup()
    assert made.cells.agg(F.max("cnt")).first()[0] == 15


def test_overfull_quotient_filter_is_refused(keys):
    made = membership.QuotientFilter.build(keys, "k", membership.QuotientFilter.sized(100, 0.01))
    with pytest.raises(ValueError, match="slots"):
        made.checked()
    assert membership.QuotientFilter.build(keys, "k", membership.QuotientFilter.sized(6000, 0.01)).checked()


def test_scalable_filters_of_many_keys():
    spec = membership.ScalableBloomFilter.sized()
    made = membership.ScalableBloomFilter.filters(spec, 40_000_000)
    assert made[-1][2] >= 40_000_000 and len(made) > 3000


def test_test_and_add_row_by_row(spark):
    rows = [(i, (i * 7) % 40 if i % 9 else None) for i in range(300)]
    spec = membership.BloomFilter.sized(12, 0.3)
    df = spark.createDataFrame(rows, "at long, k long")
    probes = {r["k"]: r["__p"] for r in membership.BloomFilter.hashed(df.select("k").distinct(), "k", spec).collect()}
    bits, want = set(), {}
    for i, k in rows:
        want[i] = None if k is None else set(probes[k]) <= bits
        bits |= set(probes.get(k, []))
    got = {r["at"]: r["member"] for r in membership.BloomFilter.test_and_add(df, "k", "at", spec).collect()}
    assert got == want


@pytest.mark.parametrize("kind", [membership.BloomFilter, membership.PartitionedBloomFilter, membership.BloomFilter64])
def test_filters_miss_no_key_and_refuse_most_others(spark, keys, kind):
    made = kind.build(keys, "k", kind.sized(3000, 0.01))
    asked = spark.range(9000).select((F.col("id") * 7).alias("k"))
    got = made.test(asked, "k").groupBy((F.col("k") < 21000).alias("in")).agg(F.avg(F.col("member").cast("int")).alias("r")).collect()
    rate = {r["in"]: r["r"] for r in got}
    assert rate[True] == 1.0
    assert rate[False] < 0.03
    by = kind.build(keys, "k", kind.sized(3000, 0.01), ("g",)).test(keys.select("k", "g"), "k")
    assert by.where("not member").isEmpty()


def test_null_and_empty_tables(spark, keys):
    none = keys.limit(0)
    assert membership.BloomFilter.build(none, "k", membership.BloomFilter.sized(10, 0.1)).test(keys.limit(3), "k").where("member").isEmpty()
    some = spark.createDataFrame([(None,), (1,)], "k long")
    got = membership.BloomFilter.build(some, "k", membership.BloomFilter.sized(10, 0.1)).test(some, "k").collect()
    assert {r["k"]: r["member"] for r in got} == {None: None, 1: True}
    assert quantiles.DDSketch.build(none, "k", quantiles.DDSketch.sized(0.1)).quantiles([0.5]).isEmpty()


def test_removal(keys):
    odd, even = keys.where("id % 2 = 1"), keys.where("id % 2 = 0")
    for made in (
        membership.CountingBloomFilter.build(keys, "k", membership.CountingBloomFilter.sized(3000, 0.001, 8)).remove(odd, "k"),
        membership.DeletableBloomFilter.build(keys, "k", membership.DeletableBloomFilter.sized(3000, 0.001, 400)).remove(odd, "k"),
        membership.QuotientFilter.build(keys, "k", membership.QuotientFilter.sized(3000, 0.0001)).remove(odd, "k"),
        ranges.InfiniFilter.build(keys, "k", "id", ranges.InfiniFilter.sized(256, 16)).remove(odd, "k"),
    ):
        assert made.test(even, "k").where("not member").isEmpty()
    assert made.test(odd, "k").where("member").count() < 60


def test_theta_algebra_is_exact_while_small(keys):
    spec = cardinality.ThetaSketch.sized(4096)
    a, b = (cardinality.ThetaSketch.build(keys.where(c), "k", spec) for c in ("id < 2000", "id >= 1500"))
    n = lambda s: s.count().first()[0]
    assert (n(a), n(b), n(a.union(b)), n(a.intersect(b)), n(a.difference(b))) == (2000, 1500, 3000, 500, 1500)


def test_theta_keeps_the_smallest_hashes(keys):
    made = cardinality.ThetaSketch.build(keys, "k", cardinality.ThetaSketch.sized(128)).cells
    every = cardinality.ThetaSketch.hashed(keys, "k", {"hash": "md5"}).select("h").distinct()
    theta = made.agg(F.min("theta")).first()[0]
    assert made.count() == 128
    assert same(made.select("h"), every.where(F.col("h") < theta))


@pytest.mark.parametrize("made", [cardinality.HyperLogLog, cardinality.HyperLogLogPlus, cardinality.UltraLogLog])
def test_counts_within_bounds(keys, made):
    spec = made.sized(1024) if made is cardinality.HyperLogLog else made.sized(10)
    got = made.build(keys, "k", spec, ("g",)).count().collect()
    assert all(abs(r["estimate"] - 1000) < 150 for r in got)


def test_frequency(keys):
    cms = frequency.CountMinSketch.build(keys, "few", frequency.CountMinSketch.sized(0.001, 0.01))
    assert cms.estimate(keys, "few").where("estimate < 60").isEmpty()
    assert frequency.top_k(keys.unionAll(keys.where("few = 7")), "few", 1, cms.spec).first()["few"] == 7
    sub = frequency.SublimeCountMinSketch.build(keys, "few", "id", frequency.SublimeCountMinSketch.sized(width=8))
    assert sub.spec["epochs"] > 2
    assert sub.estimate(keys, "few").where("estimate < 60").isEmpty()
    heavy = folds.heavy_keeper(keys.unionAll(keys.where("few = 7").withColumn("id", F.col("id") + 3000)), "few", "id", 5)
    assert heavy.first()["few"] == "7"


def test_sublime_contracts(keys):
    made = frequency.SublimeCountMinSketch.build(keys, "few", "id", frequency.SublimeCountMinSketch.sized(width=8))
    small = made.remove(keys.where("id >= 100"), "few")
    assert 1 <= small.spec["epochs"] < made.spec["epochs"] and small.total() == 100
    assert small.estimate(keys, "few").where("estimate < 2").isEmpty()
    none = made.remove(keys, "few")
    assert none.spec["epochs"] == 1 and none.estimate(keys, "few").where("estimate > 0").isEmpty()


def test_places_without_one_task(keys):
    got = membership.with_place(keys.select("id"), "id", rows=100)
    assert got.where("place <> id").isEmpty()


def test_reconcile(spark):
    a, b = spark.range(5000), spark.range(3, 5004)
    got = {(r["key"], r["side"]) for r in reconcile.difference(a, b, "id", 10).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (5000, -1), (5001, -1), (5002, -1), (5003, -1)}


def test_quantile_bound(spark):
    df = spark.range(1, 10001).select((F.col("id") - 5000).cast("double").alias("v"))
    made = quantiles.DDSketch.build(df, "v", quantiles.DDSketch.sized(0.01))
    for r in made.quantiles([0.1, 0.5, 0.9]).collect():
        true = -4999 + r["q"] * 9999
        assert abs(r["value"] - true) <= 0.011 * abs(true) + 1
    with pytest.raises(Exception, match="finite"):
        quantiles.DDSketch.build(spark.sql("select double('NaN') as v"), "v", made.spec).cells.collect()


def test_ranges(spark, keys):
    asked = keys.select((F.col("k") - 3).alias("a"), (F.col("k") + 3).alias("b"))
    graf = ranges.Grafite.build(keys, "k", ranges.Grafite.sized(3000, 64, 0.01))
    mem = ranges.MementoFilter.build(keys, "k", "id", ranges.MementoFilter.sized(64, 256, 14))
    for made in (graf, mem):
        assert made.may_hold(asked.where("a >= 0"), "a", "b").where("not may_hold").isEmpty()
        empty = keys.select((F.col("k") * 100 + 1_000_000).alias("a"), (F.col("k") * 100 + 1_000_030).alias("b"))
        assert made.may_hold(empty, "a", "b").where("may_hold").count() < 200
    assert graf.may_hold(spark.createDataFrame([(5, 4)], "a long, b long"), "a", "b").first()["may_hold"] is False


def test_small_members(spark, keys):
    graf = ranges.Grafite.build(keys, "k", ranges.Grafite.sized(3000, 64, 0.01))
    assert 0.009 < graf.false_positive_rate(64) <= 0.01 and graf.false_positive_rate(1 << 40) == 1.0
    infini = ranges.InfiniFilter.build(keys, "k", "id", ranges.InfiniFilter.sized(64, 16))
    assert infini.expansions == 6  # three quarters of 64, 128, ... slots
    answers, left = infini.test_and_remove(keys.where("id < 1000"), "k")
    assert answers.where("not member").isEmpty()
    assert left.test(keys.where("id >= 1000"), "k").where("not member").isEmpty()
    assert left.test(keys.where("id < 1000"), "k").where("member").count() < 60
    assert spark.range(1).select(hashing.hex_digest(F.unhex(F.lit("00ffa1"))).alias("x")).first()["x"] == "00FFA1"


def test_static(spark, keys):
    fuse = static_filters.BinaryFuseFilter.build(keys, "k", static_filters.BinaryFuseFilter.sized(3000, 8) | {"shards": 3})
    assert fuse.test(keys, "k").where("not member").isEmpty()
    assert fuse.test(spark.range(50000, 60000).withColumnRenamed("id", "k"), "k").where("member").count() < 100 + 1500
    bl = static_filters.BloomierFilter.build(keys, "k", static_filters.BloomierFilter.sized(3000, 8), value="few")
    assert bl.lookup(keys, "k", "v").where("v <> few or v is null").isEmpty()
    with pytest.raises(Exception, match="two values"):
        static_filters.BloomierFilter.build(keys.withColumn("c", F.lit(1)), "c", bl.spec, value="few").cells.collect()


def test_cuckoo_undoes_what_fails():
    t = folds.CuckooTable(4, 8)
    held = [i for i in range(40) if t.add(str(i).encode())]
    assert len(held) <= 16 < 40
    assert all(str(i).encode() in t for i in held)
    assert all(t.remove(str(i).encode()) for i in held)
    assert not any(t.table)


def test_stable_points():
    spec = folds.StableBloomFilter.sized(10_000, 3, 0.01)
    assert 0 < folds.StableBloomFilter.stable_point(spec) < 1
    assert folds.StableBloomFilter.stable_point(folds.StableBloomFilter.unstable(100)) == 0.0


def test_sample(keys):
    df = keys.select("id", (F.col("id") + 1.0).alias("w"))
    s = sampling.var_opt(df, "w", 100, "id")
    assert s.count() == 100
    assert math.isclose(s.agg(F.sum("adjusted")).first()[0], 3000 * 3001 / 2, rel_tol=1e-9)
    assert sampling.var_opt(df, "w", 5000, "id").count() == 3000
    again = sampling.var_opt(s.drop("w"), "adjusted", 50, "id", out="adjusted2")
    assert again.count() == 50


def test_similarity(spark):
    bags = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "e"]), (3, ["x"])], "id long, bag array<string>")
    sig = similarity.MinHash.signatures(bags, "id", "bag", 256)
    a, b = sig.select(F.col("id").alias("a"), F.col("signature").alias("s")), sig.select(F.col("id").alias("b"), F.col("signature").alias("t"))
    got = {(r["a"], r["b"]): r["j"] for r in a.crossJoin(b).select("a", "b", similarity.MinHash.similarity(F.col("s"), F.col("t")).alias("j")).collect()}
    assert got[1, 1] == 1.0
    assert abs(got[1, 2] - 0.6) < 0.12
    assert got[1, 3] == 0.0
    assert similarity.MinHashIndex.recall(0.8, *similarity.MinHashIndex.shape(128, 0.8)) > 0.9
    ours = similarity.MinHash.xxh3_signature(spark.createDataFrame([(["alpha", "beta", "gamma"],)], "t array<string>"), "t", 2).first()["signature"]
    want = [min(hashing.xxh3_64(x.encode(), i) for x in ("alpha", "beta", "gamma")) for i in range(2)]
    assert [x % (1 << 64) for x in ours] == want


def test_setsketch(keys):
    spec = similarity.SetSketch.sized(m=512)
    a, b = (similarity.SetSketch.build(keys.where(c), "k", spec) for c in ("id < 2000", "id >= 1000"))
    r = a.compare(b).first()
    assert abs(r["n_a"] - 2000) < 300
    assert abs(r["jaccard"] - 1 / 3) < 0.12
    assert same(a.merge(b).cells, similarity.SetSketch.build(keys, "k", spec).cells)


def test_codec_and_tables(spark, keys, tmp_path):
    made = cardinality.HyperLogLog.build(keys, "k", cardinality.HyperLogLog.sized(64))
    raw = codec.to_bytes(made)
    assert same(codec.from_bytes(spark, cardinality.HyperLogLog, raw).cells, made.cells)
    for bad in (raw[:-1], b"XXXX" + raw[4:], raw[:20] + bytes([raw[20] ^ 1]) + raw[21:], raw[:4] + b"\x09" + raw[5:]):
        with pytest.raises(ValueError):
            codec.opened(bad)
    with pytest.raises(ValueError):
        codec.from_bytes(spark, membership.BloomFilter, raw)
    other = cardinality.ThetaSketch.build(keys, "k", cardinality.ThetaSketch.sized(64))
    kinds = {"a": cardinality.HyperLogLog, "b": cardinality.ThetaSketch}
    both = codec.nested({"a": made, "b": other})
    parts = codec.from_nested(spark, both, kinds)
    assert same(parts["a"].cells, made.cells) and same(parts["b"].cells.select("h", "theta"), other.cells.select("h", "theta"))
    for bad, asked in ((both[:-1], kinds), (both, {"a": cardinality.HyperLogLog}), (raw, kinds), (both, kinds | {"c": cardinality.HyperLogLog})):
        with pytest.raises(ValueError):
            codec.from_nested(spark, bad, asked)
    tables.save(made, str(tmp_path / "s"))
    back = tables.load(spark, cardinality.HyperLogLog, str(tmp_path / "s"))
    assert back.spec == made.spec
    assert same(back.merge(made).cells, made.cells)


def test_sliding_window(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id")
    w = windows.SlidingWindow(600, 10)
    made = w.build(cardinality.ThetaSketch, df, "ts", "id", cardinality.ThetaSketch.sized(4096))
    got = {r["bucket"]: r["estimate"] for r in w.merged(made).count().collect()}
    assert got[0] == 1
    assert got[50] == 10


def test_places_of_bunched_numbers(spark, keys):
    bunched = spark.range(3000).selectExpr("case when id < 2900 then id else id * 10000000000 end as at").unionAll(spark.sql("select cast(null as long) as at")).repartition(5)
    got = [r["at"] for r in membership.with_place(bunched, "at", rows=100).orderBy("place").collect()]
    assert got == [None, *sorted(x for x in got if x is not None)] and len(got) == 3001


def test_scalable_in_one_array_and_by_join(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("k"))
    made = membership.ScalableBloomFilter.build(rows, "k", "k", membership.ScalableBloomFilter.sized(300, 0.01))
    asked = spark.range(6000).select(F.col("id").alias("k")).unionAll(spark.sql("select cast(null as long) as k"))
    near = {r["k"]: r["member"] for r in made.test(asked, "k").collect()}
    assert near[None] is None and all(near[k] for k in range(3000)) and sum(near[k] for k in range(3000, 6000)) < 300
    monkeypatch.setattr(membership, "BROADCAST_BITS", 100)
    assert {r["k"]: r["member"] for r in made.test(asked, "k").collect()} == near


def _sent_whole(df):
    """Joins of the plan that build a side on the driver, but for the few ranges that places are counted in."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return [x for x in lines if ("BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x) and "__range" not in x and "__before" not in x]


def test_infini_sends_nothing_whole(spark, keys):
    made = ranges.InfiniFilter.build(keys, "k", "id", ranges.InfiniFilter.sized(64, 16)).remove(keys.where("id < 1000"), "k")
    assert _sent_whole(made.test(keys, "k")) == []


def test_bloom_sends_nothing_whole(spark, keys, monkeypatch):
    monkeypatch.setattr(membership, "BROADCAST_BITS", 100)
    made = membership.BloomFilter.build(keys, "k", membership.BloomFilter.sized(3000, 0.01))
    assert _sent_whole(made.test(keys, "k")) == []
    assert _sent_whole(membership.BloomFilter.test_and_add(keys, "k", "id", made.spec)) == []


def test_memento_sends_nothing_whole(spark, keys):
    made = ranges.MementoFilter.build(keys, "k", "id", ranges.MementoFilter.sized(64, 256, 14)).remove(keys.where("id < 1000"), "k")
    assert _sent_whole(made.may_hold(keys.select(F.col("k").alias("a"), (F.col("k") + 3).alias("b")), "a", "b")) == []


def test_sparse_counts_stay_exact(spark):
    rows = spark.range(30_000).select(F.col("id").alias("k"), F.when(F.col("id") < 29_000, "a").otherwise("b").alias("g"))
    rows = rows.unionAll(rows).unionAll(spark.sql("select cast(null as long), 'b'"))
    spec = cardinality.HyperLogLogPlus.sized(8)  # sparse up to 32 hashes
    got = cardinality.HyperLogLogPlus.exact(rows, "k", spec, ("g",))
    assert {tuple(x) for x in got.collect()} == {("a", 29_000), ("b", 1_000)}
    assert cardinality.HyperLogLogPlus.exact(rows, "k", spec).first()[0] == 30_000
    assert cardinality.HyperLogLogPlus.exact(rows.where("k < 9"), "k", spec).first()[0] == 9


def test_shards_lie_alone_and_grow_with_the_keys(spark, keys):
    rows = folds.by_shard(keys, "k", "id", 20).select("__shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(rows) == 20 == len({r["p"] for r in rows})
    small, large = (folds.CuckooFilter.sized(n, 0.01) for n in (150_000, 60_000_000))
    assert small["shards"] == 8 and large["buckets"] <= 2 * small["buckets"] * 4


def test_cuckoo_table_is_packed():
    t = folds.CuckooTable(1 << 12, 13)
    assert t.table.itemsize * len(t.table) + len(t.size) == 9 * (1 << 12)
    assert t.add(b"a") and t.add(b"b") and b"a" in t and t.remove(b"a") and not t.remove(b"a") and b"b" in t


def test_simhash_moves_no_terms(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (2, None)], "g long, t string")
    made = similarity.SimHash.build(rows, "t", {"hash": "md5"}, ("g",)).cells
    assert made._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # in place, and what is left
    assert {r["g"]: r["n"] for r in made.groupBy("g").agg(F.max(F.abs("weight")).alias("n")).collect()} == {1: 3, 2: 1}


def test_neighbours_meet_across_blocks(spark):
    bags = spark.range(1000).where("id % 97 <> 5").selectExpr("id", "transform(sequence(id, id + id % 7), x -> string(x)) as bag")
    of = {r["id"]: set(r["bag"]) for r in bags.collect()}
    for step in (1, 2):
        got = similarity.with_next(similarity.hashed_terms(bags, "id", "bag"), step, 10)
        want = {(i, i + 1, len(of[i] & of[i + 1]), len(of[i]), len(of[i + 1])) for i in of if i + 1 in of and i % step == 0}
        assert sorted(tuple(x) for x in got.collect()) == sorted(want)
        assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()  # bags don't travel twice


def test_signatures_stay_in_their_rows(spark):
    bags = spark.range(300).selectExpr("id", "transform(sequence(1, id * 37 % 200), x -> x * 31) as t").withColumn("t", F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") == 8, F.array().cast("array<int>")).otherwise(F.col("t")))
    rows = bags.select("id", F.transform("t", lambda x: F.xxhash64(x)).alias("t")).where("id <> 0")
    made = similarity.MinHash.signed(rows, 16, "s")
    assert "Exchange" not in made._jdf.queryExecution().sparkPlan().toString()

    def plain(t):
        x = [[hashing.mix64((h & hashing.MASK64) ^ hashing.SplitMix64(i).next()) for h in t] for i in range(16)]
        return [min(y) - (1 << 64) * (min(y) >> 63) for y in x]

    assert all(r["s"] == (plain(r["t"]) if r["t"] else None) for r in made.collect())


def test_pairs_are_judged_once_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(similarity, "BLOCK_TERMS", 2000)
    r, rows = random.Random(2), []
    for g in range(6):
        base = [r.getrandbits(60) for _ in range(80)]
        rows += [(100 * g + i, sorted({*base[r.randrange(12) :], r.getrandbits(60)})) for i in range(25)]
    rows += [(900 + i, [r.getrandbits(60)]) for i in range(20)] + [(999, [])]
    bags = {i: set(t) for i, t in rows}
    want = {(a, b) for a in bags for b in bags if a < b and bags[a] and 5 * len(bags[a] & bags[b]) >= 4 * len(bags[a] | bags[b])}
    signed = similarity.MinHash.signed(spark.createDataFrame(rows, "id long, t array<long>"), 126).cache()
    found = similarity.verified_pairs(signed, 42, 3, 0.8)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
