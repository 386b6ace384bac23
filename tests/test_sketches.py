import pytest
from pyspark.sql import functions as F

from driftwell.functions.hashing import utf16
from driftwell.operators import bloom, charpoly, ibf, reconcile, strata
from driftwell.plans import sync
from driftwell.sources.generator import generate, true_difference


def ids(spark, lo, hi):
    return spark.range(lo, hi)


def test_bloom_membership(spark):
    words = spark.range(5000).select(utf16(F.concat(F.lit("Test "), F.lpad(F.col("id").cast("string"), 5, "0"))).alias("w"))
    empty = bloom.build(words.where("false"), F.col("w"), 1_000_000, 0)
    assert bloom.probe(words, F.col("w"), empty).where("hit").count() == 0
    full = bloom.build(words, F.col("w"), 1_000_000, 5000)
    assert bloom.probe(words, F.col("w"), full).where("NOT hit").count() == 0


def test_bloom_joined_and_broadcast_agree(spark, monkeypatch):
    items = spark.range(400).selectExpr("id", "id % 7 AS hit_not", "'x' AS row")
    made = bloom.build(spark.range(0, 400, 3), F.col("id"), 65536 + 800, 134)
    one = bloom.probe(items, F.col("id"), made)
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 0)
    other = bloom.probe(items, F.col("id"), made)
    assert one.columns == other.columns and sorted(one.collect()) == sorted(other.collect()) and one.where("hit").count() >= 134


def test_bloom_rules(spark):
    rows = spark.range(10)
    with pytest.raises(ValueError, match="divisible by 8"):
        bloom.build(rows, F.col("id"), 12, 10)
    nothing = bloom.build(rows, F.col("id"), 0, 0)
    assert nothing.false_positive_rate == 0.0 and not bloom.probe(rows, F.col("id"), nothing).where("hit").count()
    assert bloom.estimate_difference(0, 7, 0, 0.0) == 7
    a, b = (bloom.build(spark.range(*r), F.col("id"), 4096, 50) for r in ((0, 50), (50, 100)))
    whole = bloom.build(spark.range(100), F.col("id"), 4096, 100)
    assert sorted(a.merge(b).bits.collect()) == sorted(whole.bits.collect()) and a.merge(b).count == 100
    assert whole.bitmap().count() == 1 and bloom.rounded(9) == 16


def test_ibf_difference_decodes(spark):
    size, hashes = 30, 5
    cells = ibf.subtract(ibf.build(ids(spark, 0, 1010), size, hashes), ibf.build(ids(spark, 0, 1000), size, hashes))
    got = ibf.decode(cells, size, hashes).collect()
    assert sorted(r.id for r in got) == list(range(1000, 1010)) and {r.side for r in got} == {1}


def test_ibf_full_decode_one_task_and_in_rounds(spark, monkeypatch):
    size = 9000
    cells = ibf.build(ids(spark, 0, 3000), size, 5)
    assert sorted(r.id for r in ibf.decode(cells, size, 5).collect()) == list(range(3000))
    monkeypatch.setattr(ibf, "ONE_TASK", 10)
    assert sorted(r.id for r in ibf.decode(cells, size, 5).collect()) == list(range(3000))


def test_ibf_failure_and_doubling(spark):
    a, b = ids(spark, 0, 500), ids(spark, 400, 600)
    with pytest.raises(Exception, match="decoding failed"):
        ibf.decode(ibf.subtract(ibf.build(a, 16), ibf.build(b, 16)), 16).collect()
    # With no attempt that decodes, the tables themselves are compared.
    for attempts in (9, 1):
        got = {(r.side, r.id) for r in ibf.difference(a, b, 10, attempts=attempts).collect()}
        assert got == {(1, i) for i in range(400)} | {(-1, i) for i in range(500, 600)}


def test_ibf_difference_is_one_of_sets(spark):
    a, b = ids(spark, 0, 50), ids(spark, 10, 60).unionByName(ids(spark, 20, 30))
    for attempts in (9, 0):
        got = {(r.side, r.id) for r in ibf.difference(a, b, 40, attempts=attempts).collect()}
        assert got == {(1, i) for i in range(10)} | {(-1, i) for i in range(50, 60)}


def test_ibf_is_linear(spark):
    parts = ibf.merge(ibf.build(ids(spark, 0, 40), 64), ibf.build(ids(spark, 40, 100), 64))
    assert sorted(parts.collect()) == sorted(ibf.build(ids(spark, 0, 100), 64).collect())
    removed = ibf.merge(ibf.build(ids(spark, 0, 100), 64), ibf.build(ids(spark, 50, 100), 64, weight=-1))
    assert sorted(removed.collect()) == sorted(ibf.build(ids(spark, 0, 50), 64).collect())
    maybe = ibf.contains(ids(spark, 0, 5000), ibf.build(ids(spark, 0, 5000), 1_000_000, 5), 1_000_000, 5)
    assert maybe.where("NOT maybe").count() == 0


@pytest.mark.parametrize(("size", "changed", "rows", "signed", "absolute"), [(1000, 4, 1020, 20, 60), (10000, 4, 10200, 204, 556)])
def test_strata_estimates(spark, size, changed, rows, signed, absolute):
    server, client = generate(spark, size, changed), generate(spark, size, 0)
    assert server.count() == rows and true_difference(size, changed) == 1.5 * changed * size / 100
    a, b = (strata.encode(reconcile.with_id(x).select("id")) for x in (server, client))
    assert strata.estimate(a, b) == signed and strata.estimate(a, b, signed=False) == absolute


def test_generator_value(spark):
    half = "BC-76-4C-D8-DD-F7-A0-CF-F1-26-F5-1C-16-23-96-58"
    assert generate(spark, 1000, 0).first().value == half + half


@pytest.mark.parametrize(("n", "m", "patch", "estimate", "remaining"), [(20, 25, 5, 26, 21), (200, 250, 49, 71, 22)])
def test_kv_sync(spark, n, m, patch, estimate, remaining):
    make = lambda k: spark.range(k).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    server, client = make(m), make(n)
    first = sync.first_patch(server, sync.client_bloom(client))
    assert (first.rows.count(), first.estimate, first.remaining) == (patch, estimate, remaining)
    assert reconcile.equal(server, sync.two_phase(server, client)).first().equal
    assert reconcile.equal(server, sync.single_round(server, client)).first().equal


def test_deletes_only_on_request(spark):
    server = generate(spark, 300, 4)
    extra = spark.createDataFrame([("mine", "x")], "key string, value string")
    client = generate(spark, 300, 0).unionByName(extra)
    kept, cleaned = sync.two_phase(server, client), sync.two_phase(server, client, propagate_deletes=True)
    assert reconcile.set_difference(kept, server).select("key").collect() == [("mine",)]
    assert reconcile.equal(cleaned, server).first().equal


@pytest.mark.parametrize(("a", "b"), [([1, 3, 5], [3, 5]), ([5, 7, 11, 20], [13, 20]), ([1, 2], [1, 2]), ([], [4]), ([9, 9, 8], [8])])
def test_charpoly_difference(spark, a, b):
    frames = [spark.createDataFrame([(x,) for x in v], "element long") for v in (a, b)]
    got = {(r.element, r.side) for r in charpoly.difference(*frames, 1).collect()}
    assert got == {(x, 1) for x in set(a) - set(b)} | {(x, -1) for x in set(b) - set(a)}


def test_large_charpoly_differences_go_another_way(spark, monkeypatch):
    monkeypatch.setattr(charpoly, "MOST_POINTS", 20)
    a, b = (spark.range(*r).withColumnRenamed("id", "element") for r in ((0, 200), (150, 210)))
    got = {(r.element, r.side) for r in charpoly.difference(a, b, 2).collect()}
    assert got == {(i, 1) for i in range(150)} | {(i, -1) for i in range(200, 210)}
