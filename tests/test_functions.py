from functools import reduce

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import bits, gf, hashing


@pytest.mark.parametrize(("wide", "expected"), [(False, 0xB0F57EE3), (True, 0x6384BA69)])
def test_murmur_verification_value(wide, expected):
    def one(raw, seed):
        if not wide:
            return hashing.murmur32_bytes([raw], seed).astype("<u4").tobytes()
        return b"".join(x.astype("<u8").tobytes() for x in hashing.murmur128_bytes([raw], seed))

    hashes = b"".join(one(bytes(range(i)), 256 - i) for i in range(256))
    assert int.from_bytes(one(hashes, 0)[:4], "little") == expected


@given(st.lists(st.binary(max_size=70), max_size=20), st.integers(0, 2**32 - 1))
def test_batched_hashes_equal_single_ones(values, seed):
    together = hashing.murmur32_bytes(values, seed)
    assert [int(h) for h in together] == [int(hashing.murmur32_bytes([v], seed)[0]) for v in values]
    a, b = hashing.murmur128_bytes(values, seed)
    for i, v in enumerate(values):
        x, y = hashing.murmur128_bytes([v], seed)
        assert (a[i], b[i]) == (x[0], y[0])


def test_native_murmur_is_seeded(spark):
    rows = spark.createDataFrame([(1,), (2,), (-5,)], "id long")
    got = rows.select("id", hashing.murmur32("id", 0).alias("a"), hashing.murmur32("id", 123456789).alias("b")).collect()
    assert [(r.a, r.b) for r in got[:2]] == [(1392991556, 869639266), (3323962100, 2236048276)]
    for r in got:
        raw = r.id.to_bytes(8, "little", signed=True)
        assert r.a == hashing.murmur32_bytes([raw], 0)[0] and r.b == hashing.murmur32_bytes([raw], 123456789)[0]


def test_kv_hashes(spark):
    rows = spark.createDataFrame([("a", "b"), ("abc", "")], "key string, value string")
    got = rows.select(hashing.murmur32_udf(hashing.item_block()).alias("h"), hashing.murmur128_hex_udf(hashing.item_block()).alias("x")).collect()
    for r, text in zip(got, ("a-b", "abc-"), strict=True):
        assert r.h == hashing.murmur32_bytes([text.encode("utf-16-le")], 0)[0]
        assert len(r.x) == 32


def test_trailing_zeros(spark):
    cases = {1: 0, 2: 1, 12: 2, -1: 0, 0: 31, 2**31: 31, 2**40: 31, -(2**30): 30, 3 * 2**29: 29, -(2**63): 31}
    rows = spark.createDataFrame([(k,) for k in cases], "id long").select("id", bits.trailing_zeros(F.col("id")).alias("z"))
    assert {r.id: r.z for r in rows.collect()} == cases


def test_trailing_zeros_of_ints(spark):
    cases = {1: 0, 12: 2, 0: 32, -1: 0, -(2**31): 31, 3 << 20: 20}
    rows = spark.createDataFrame([(k,) for k in cases], "id int").select("id", bits.trailing_zeros_int(F.col("id")).alias("z"))
    assert {r.id: r.z for r in rows.collect()} == cases


def test_fields_beyond_long_products(spark):
    p = (1 << 61) - 1
    pairs = [(p - 1, p - 2), (123456789012345678, 987654321098765432), (1, 0)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    got = rows.select(gf.add(F.col("a"), F.col("b"), p).alias("s"), gf.mul(F.col("a"), F.col("b"), p).alias("m")).collect()
    assert [(r.s, r.m) for r in got] == [((a + b) % p, a * b % p) for a, b in pairs]


def chi(elements, x, p):
    return reduce(lambda a, s: a * (x - s) % p, elements, 1)


@pytest.mark.parametrize(
    ("p", "a", "b", "points", "over", "under"),
    [
        (97, [1, 2, 9, 12, 33], [1, 2, 9, 10, 12, 28], 5, [64, 1], [86, 59, 1]),
        (67, [1, 2, 5, 11, 19], [1, 5, 7, 11], 4, [38, 46, 1], [60, 1]),
    ],
)
def test_rational_interpolation(p, a, b, points, over, under):
    xs = [-i % p for i in range(1, points + 1)]
    values = [chi(a, x, p) * pow(chi(b, x, p), -1, p) % p for x in xs]
    assert gf.rational(xs, values, len(a) - len(b), p) == (over, under)
    assert {x for x in a if not gf.poly_value(over, x, p)} == set(a) - set(b)


def test_field_columns(spark):
    rows = spark.createDataFrame([(5, 3), (-4, 2147483646)], "a long, b long")
    got = rows.select(gf.mul(gf.divide(F.col("a"), F.col("b")), F.col("b")).alias("x"), gf.add(F.col("a"), F.lit(0)).alias("y"), gf.power(F.col("b"), 7).alias("z"))
    for r, (a, b) in zip(got.collect(), [(5, 3), (-4, 2147483646)], strict=True):
        assert r.x == r.y == a % gf.PRIME and r.z == pow(b, 7, gf.PRIME)
    with pytest.raises(Exception, match="division by zero"):
        rows.select(gf.inverse(F.col("a") * 0)).collect()


def test_little_endian(spark):
    row = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05"),)], "d binary")
    got = row.select(bits.little_endian_u32(F.col("d"), 0).alias("a"), bits.little_endian_u32(F.col("d"), 4).alias("b")).first()
    assert (got.a, got.b) == (0x04030201, 5)
    assert np.uint32(got.a) == 0x04030201
