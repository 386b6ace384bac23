"""Reconciliation of two key-value tables from end to end.

Row hashes and ids are staged once; what would cross the wire is a sketch or a patch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import bloom, ibf, strata
from driftwell.operators.reconcile import apply_patch, with_hash, with_id
from driftwell.sources.tables import assert_unique
from driftwell.staging import stage

BITS_PER_ROW, PADDING = 8, 20
#: Times the signed strata estimate that a single-round filter is sized for.
STRATA_FACTOR = 4.8


@dataclass(frozen=True)
class FirstPatch:
    """Server rows that the client's Bloom filter lacks, and what is estimated to remain after them."""

    rows: DataFrame
    estimate: int
    remaining: int
    filter_bytes: int


def _as_int(h: str = "h"):
    """An unsigned 32-bit hash as the signed int of the same bytes."""
    return F.when(F.col(h) >= 1 << 31, F.col(h) - (1 << 32)).otherwise(F.col(h)).cast("int")


def client_bloom(client: DataFrame) -> bloom.Bloom:
    """8 bits a row; what is added is the 4-byte hash of each item."""
    hashed = stage(with_hash(client).select(_as_int().alias("h")), "hashes")
    n = hashed.count()
    return bloom.build(hashed, F.col("h"), BITS_PER_ROW * n, n)


def first_patch(server: DataFrame, client_filter: bloom.Bloom) -> FirstPatch:
    hashed = with_hash(server).withColumn("h", _as_int())
    probed = stage(bloom.probe(hashed, F.col("h"), client_filter), "probed")
    counts = probed.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).first()
    found = bloom.estimate_difference(client_filter.count, counts["n"], counts["hits"], client_filter.false_positive_rate) + PADDING
    missing = counts["n"] - counts["hits"]
    return FirstPatch(probed.where("NOT hit").select("key", "value"), found, max(found - missing, 1), client_filter.bytes)


def second_patch(server: DataFrame, client: DataFrame, estimate: int) -> tuple[DataFrame, DataFrame]:
    """Server rows that the client lacks, and rows (key, value) of the client alone, by invertible filters.

    Two rows of one side with one id raise a ValueError: a filter would hold them as none.
    """
    own, theirs = (assert_unique(stage(with_id(x), "ids"), "id") for x in (server, client))
    sides = ibf.difference(theirs.select("id"), own.select("id"), estimate)
    patch = own.join(sides.where("side = -1"), "id", "left_semi").select("key", "value")
    extra = theirs.join(sides.where("side = 1"), "id", "left_semi").select("key", "value")
    return patch, extra


@dataclass(frozen=True)
class Synced:
    """The client after a sync, the patches that made it so, and what the sketches were sized for."""

    rows: DataFrame
    first: DataFrame | None
    second: DataFrame
    estimate: int
    filter_bytes: int


def two_phase(server: DataFrame, client: DataFrame, propagate_deletes: bool = False) -> DataFrame:
    """The client after both phases: a Bloom filter finds most missing rows, an invertible one the rest.

    Rows of the client whose key the server lacks stay, unless ``propagate_deletes``.
    """
    return two_phase_report(server, client, propagate_deletes).rows


def two_phase_report(server: DataFrame, client: DataFrame, propagate_deletes: bool = False) -> Synced:
    patch = first_patch(server, client_bloom(client))
    patched = stage(apply_patch(client, patch.rows), "patched")
    rest, extra = second_patch(server, patched, patch.remaining)
    return Synced(_finished(patched, rest, extra, server, propagate_deletes), patch.rows, rest, patch.remaining, patch.filter_bytes)


def single_round(server: DataFrame, client: DataFrame, propagate_deletes: bool = False) -> DataFrame:
    """The client after one round whose invertible filter is sized from a strata estimate."""
    return single_round_report(server, client, propagate_deletes).rows


def single_round_report(server: DataFrame, client: DataFrame, propagate_deletes: bool = False) -> Synced:
    own, theirs = stage(with_id(server).select("id"), "ids"), stage(with_id(client).select("id"), "ids")
    found = strata.estimate(strata.encode(own), strata.encode(theirs))
    estimate = int(abs(found) * STRATA_FACTOR) + PADDING
    rest, extra = second_patch(server, client, estimate)
    return Synced(_finished(client, rest, extra, server, propagate_deletes), None, rest, estimate, 0)


def _finished(client: DataFrame, patch: DataFrame, extra: DataFrame, server: DataFrame, deletes: bool) -> DataFrame:
    gone = extra.select("key").join(server.select("key"), "key", "left_anti") if deletes else None
    return apply_patch(client, patch, gone)
