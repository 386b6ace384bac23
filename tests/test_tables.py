import time

import pytest
from pyspark.sql import functions as F

from driftwell.operators import chunking, delta, reconcile
from driftwell.plans import files, sync
from driftwell.sources import stores
from driftwell.sources.tables import assert_unique
from driftwell import staging
from driftwell.streaming.live_ibf import maintain
from driftwell.operators import ibf
import numpy as np


def kv(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_classes_and_patches(spark):
    server = kv(spark, [("a", "1"), ("b", "2"), ("c", None), ("d", "4")])
    client = kv(spark, [("a", "1"), ("b", "9"), ("c", None), ("e", "5")])
    assert {(r.key, r["class"]) for r in reconcile.classes(server, client).collect()} == {
        ("a", "same"), ("b", "modified"), ("c", "same"), ("d", "server_only"), ("e", "client_only")
    }
    assert reconcile.difference_count(server, client).first().differences == 2
    assert not reconcile.equal(server, client).first().equal and reconcile.equal(server, server).first().equal
    patched = reconcile.apply_patch(client, server)
    assert {(r.key, r.value) for r in patched.collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "4"), ("e", "5")}
    assert {r.key for r in reconcile.missing(server, client).collect()} == {"b", "d"}
    assert {r.key for r in reconcile.hash_list_patch(server, client).collect()} == {"b", "d"}
    with pytest.raises(ValueError, match="duplicate"):
        assert_unique(server.unionByName(server))


def test_null_values_are_items_of_their_own(spark):
    server = kv(spark, [("a", None), ("b", None), ("c", ""), ("d", "4")])
    client = kv(spark, [("a", None), ("c", None), ("d", "4")])
    want = {("b", None), ("c", "")}
    assert {tuple(r) for r in reconcile.hash_list_patch(server, client).collect()} == want
    for run in (sync.two_phase, sync.single_round):
        assert reconcile.equal(server, run(server, client)).first().equal


def test_shared_ids_raise(spark, monkeypatch):
    server, client = kv(spark, [("a", "1"), ("b", "2")]), kv(spark, [("a", "1")])
    monkeypatch.setattr(sync, "with_id", lambda rows: rows.withColumn("id", F.lit(7).cast("long")))
    with pytest.raises(ValueError, match="duplicate id"):
        sync.second_patch(server, client, 4)


def test_hash_list_round_trip(spark, tmp_path):
    server, client = kv(spark, [("a", "1"), ("b", None), ("c", "3")]), kv(spark, [("a", "1"), ("c", "9")])
    stores.save_hash_list(client, str(tmp_path / "hashes"))
    assert {r.key for r in reconcile.hash_list_patch(server, stores.load_sketch(spark, str(tmp_path / "hashes"))).collect()} == {"b", "c"}


def test_folders_are_synced(spark, tmp_path):
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 256, 40_000).astype(np.uint8).tobytes()
    old = {"a": whole, "s/b": whole[:9000], "gone": b"x", "same": whole[5000:9000]}
    new = {"a": whole[:7000] + b"middle" + whole[7100:], "s/b": b"front" + whole[:9000], "fresh": b"y", "same": whole[5000:9000]}
    for side, files_ in (("old", old), ("new", new)):
        for name, raw in files_.items():
            (tmp_path / side / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_bytes(raw)
    sides = [stores.list_files(spark, str(tmp_path / s)) for s in ("old", "new")]
    both = set(old) & set(new)  # files of one side alone are skipped
    for half, got in ((256, files.sync_variable(*sides, "path", "content", half=256)), (0, files.sync_fixed(*sides, "path", "content", 512))):
        rows = {r.path: r for r in got.collect()}
        assert {n: bytes(r.data) for n, r in rows.items()} == {n: new[n] for n in both}
        assert rows["a"].literal_bytes < 3000 and rows["a"].refs > 10
        assert rows["same"].literal_bytes == (0 if half else len(new["same"]) % 512)


def test_exchange_finds_what_is_missing():
    rng = np.random.default_rng(2)
    for n, m, shared in ((0, 0, 0), (0, 9, 0), (9, 0, 0), (50, 40, 30), (300, 300, 299), (700, 400, 100)):
        pool = rng.choice(1 << 28, n + m, replace=False).astype(np.int64)
        old, new = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
        missing, _, filter_bytes, sent = files.exchange(old, new)
        assert sorted(missing) == sorted(set(new.tolist()) - set(old.tolist())) and filter_bytes == -(-12 * len(new) // 8) + 4
        assert sent > 0


def test_chunks_that_share_hash_bits_are_told_apart(spark):
    rng = np.random.default_rng(4)
    old, fresh = (rng.integers(0, 256, 300_000).astype(np.uint8).tobytes() for _ in range(2))
    new = fresh[:200_000] + old[100_000:] + fresh[200_000:]  # so many chunks that some share 28 bits
    sides = [spark.createDataFrame([(1, bytearray(x)), (2, bytearray(x[:500]))], "k long, data binary") for x in (old, new)]
    rows = {r.k: r for r in files.sync_variable(*sides, "k", "data", half=2).collect()}
    assert bytes(rows[1].data) == new and bytes(rows[2].data) == new[:500]
    of = [{r.chunk for r in chunking.chunks(x.where("k = 1"), "k", "data", half=2, hashed=False).select(F.hex("chunk").alias("chunk")).collect()} for x in sides]
    assert rows[1].bloom_bytes == -(-12 * len(of[1]) // 8) + 4


def test_exchange_takes_other_bits_and_then_digests():
    rng = np.random.default_rng(6)
    digests = [rng.bytes(files.DIGEST) for _ in range(40)]
    twin = digests[0][:4] + digests[1][4:8] + rng.bytes(8)  # shares its first bits with one and its next with another
    old, new = digests[:30], [*digests[10:], twin]
    for bits in (files.HASH_BITS, 4):  # 4 bits tell 41 digests apart nowhere
        missing, _, filter_bytes, sent = files.exchange_digests(old, new, bits)
        assert sorted(missing) == sorted({*new} - {*old}) and filter_bytes == -(-12 * len(new) // 8) + 4 and sent > 0
    assert files.exchange_digests([], [])[0] == []


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.upsert(kv(spark, [("a", "1")]), kv(spark, [("a", "2"), ("b", "3")]), path)
    store = stores.scan(spark, path)
    assert {(r.key, r.value) for r in store.collect()} == {("a", "2"), ("b", "3")}
    with pytest.raises(Exception, match="no such key"):
        stores.point_read(store, kv(spark, [("zz", "")])).collect()
    stores.save_sketch(ibf.build(spark.range(5), 16), str(tmp_path / "cells"))
    assert stores.load_sketch(spark, str(tmp_path / "cells")).count() > 0


def test_folders(spark, tmp_path):
    for side, files in (("x", {"a": b"1", "s/b": b"2", "c": b"3"}), ("y", {"a": b"1", "s/b": b"9", "d": b"4"})):
        for name, raw in files.items():
            (tmp_path / side / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_bytes(raw)
    got = stores.compare_folders(*(stores.list_files(spark, str(tmp_path / s)) for s in ("x", "y")))
    assert {tuple(r) for r in got.collect()} == {("a", "same"), ("s/b", "different"), ("c", "left_only"), ("d", "right_only")}


def direct_adler(raw, at, n):
    window = raw[at : at + n].ljust(n, b"\0")
    return sum(b + 31 for b in window) % 65536 + ((sum((n - i) * (b + 31) for i, b in enumerate(window)) % 65536) << 16)


@pytest.mark.parametrize("text", ["", "asdf", "".join(map(str, range(99)))])
def test_rolling_hash(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    assert chunking.rolling_adler(data, 5).tolist() == [direct_adler(text.encode(), i, 5) for i in range(len(text))]
    assert chunking.rolling_u32(data).tolist() == [int.from_bytes(text.encode()[i : i + 4], "little") for i in range(len(text))]


def test_local_maxima_goldens():
    values = "9 21 19 13 27 18 26 25 24 16 35 35 37 20 40 45 10 10 10 10 20 10 20 30 10 35 40 10 10 10 10 20"
    assert chunking.local_maxima(np.array(values.split(), dtype=np.int64), 2).tolist() == [1, 4, 15, 26, 31]
    assert chunking.local_maxima(np.array([1, 1, 10, 1, 1, 1, 1, 10, 10]), 5).tolist() == []
    rng = np.random.default_rng(0)
    for half in (1, 2, 3, 7, 40):
        v = rng.integers(0, 9, 60)
        naive = [i for i in range(60) if all(v[i] > v[j] for j in range(max(0, i - half), min(60, i + half + 1)) if j != i)]
        assert chunking.local_maxima(v, half).tolist() == naive


def test_partition_and_rebuild(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abcdef")), (2, bytearray(b""))], "doc long, data binary")
    got = chunking.cut(rows, "doc", "data", F.when(F.col("doc") == 1, F.array(F.lit(2).cast("long"), F.lit(5).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    assert [(r.seq, r.pos, r.len, bytes(r.chunk)) for r in got.orderBy("seq").collect()] == [(0, 0, 3, b"abc"), (1, 3, 3, b"def")]


@pytest.mark.parametrize("block", [4, 16])
def test_fixed_delta_rebuilds(spark, block):
    old = bytes(np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint8))
    new = b"xx" + old[100:2000] + b"middle" + old[500:] + b"z"
    pair = spark.createDataFrame([(1, bytearray(new), bytearray(old)), (2, bytearray(b""), bytearray(old)), (3, bytearray(b"q"), bytearray(b""))], "k long, new binary, old binary")
    steps = delta.fixed_delta(pair, "k", "new", "old", block)
    blocks = delta.old_blocks(pair, "k", "old", block)
    assert {r.k: bytes(r.data) for r in delta.apply_fixed(steps, blocks, "k").collect()} == {1: new, 3: b"q"}
    assert delta.missing_hashes(steps, blocks, "k").count() == 0
    size = delta.size(steps.where("k = 1"), reference=8).first().bytes
    assert (size < len(new)) == (block > 8)  # a reference takes 8 bytes


def test_streamed_cells_equal_batch(spark, tmp_path):
    spark.range(100).selectExpr("id", "1 AS weight").write.parquet(str(tmp_path / "in"))
    spark.range(90, 100).selectExpr("id", "-1 AS weight").write.mode("append").parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("id long, weight int").parquet(str(tmp_path / "in"))
    maintain(changes, 64, "cells", str(tmp_path / "check")).awaitTermination(60)
    live = spark.table("cells").where("cnt <> 0 OR id_sum <> 0 OR hash_sum <> 0")
    assert sorted(live.collect()) == sorted(ibf.build(spark.range(90), 64).collect())


def test_staging_frees_shuffles_and_leaves_the_session_alone(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    new_id = spark.sparkContext._jsc.sc().newShuffleId
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    first = new_id()
    staged = staging.stage(counted, "counted")
    last = new_id()
    assert last > first + 1  # a shuffle was made
    held = lambda: [b for b in map(str, disk.getAllBlocks().mkString(" ").split()) if b.startswith("shuffle_") and first < int(b.split("_")[1]) < last]
    stop = time.monotonic() + 20
    while held() and time.monotonic() < stop:  # Spark deletes them in the background
        time.sleep(0.1)
    assert not held()
    assert sorted(r["count"] for r in staged.collect()) == [142] + [143] * 6
    assert spark.conf.get(staging.CLEANUP, None) is None
    staging.drop(staged)
