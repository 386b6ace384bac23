"""Near-dedup by min-max hashing.

A text's set holds the hashes of its distinct 5-word shingles. Under each permutation of the
hash space both the least and the greatest element are kept: two signature values for one
evaluation, each equal between two sets with probability their Jaccard similarity. Bands of
values bring candidates together; every link is then confirmed on full sets.

Only components are asked for, so the work is kept linear in the size of hot groups:

1. Rows with equal sets become one class.
2. In each bucket every class is compared to the least class there (a star). The sets meet in
   salted groups of bounded size, in a stream, with the leader's set in front.
3. In buckets that still hold several components, the classes outside the largest component are cut into blocks
   of bounded size, and all classes of the bucket stream past each block. Pairs are compared there and
   never written out; only the links that join two components are.
4. Buckets that would need more than one block are searched by prefix filtering instead, which is exact as well: two
   sets that are similar enough share one of their rarest elements, so only the rarest few of each set bring
   classes together again, as step 3 does with buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, documents, drop, in_batches, materialise, partitions, with_ranks
from .components import connected_components
from .textvec import mix, shingles

WIDTH = 5
#: 32 bands of 6 values from 96 permutations: a pair at similarity 0.85 shares no band once in
#: four million pairs, one at 0.8 once in ten thousand.
BANDS, ROWS = 32, 6
#: About the most members of a star's salted group and of a block, and the most elements of a block's sets together.
GROUP, GROUP_ITEMS = 256, 1 << 19
#: Bits of the table of counters that orders elements by rarity.
COUNTER_BITS = 16

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, BANDS * ROWS // 2, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(1, 2**63, BANDS * ROWS // 2, dtype=np.uint64)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(items: np.ndarray) -> np.ndarray:
    """Least and greatest value of a non-empty set under each permutation, least values first."""
    low = np.full(len(_A), ~_U(0), dtype=np.uint64)
    high = np.zeros(len(_A), dtype=np.uint64)
    for i in range(0, len(items), 512):  # blocks that stay in cache
        under = _A[:, None] * items[None, i : i + 512] + _B[:, None]
        np.minimum(low, under.min(axis=1), out=low)
        np.maximum(high, under.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = _SALT.copy()
    # Minima fill the first half of the bands and maxima the second.
    for column in values.reshape(BANDS, ROWS).T:
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + column)
    return keys


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large or not small:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _signatures(docs: DataFrame) -> DataFrame:
    """(did, th, n, s1, s2, bands): text hash, set size, two digests of the set (0 if empty) and its band keys."""
    out = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                items = shingles(text.as_py(), WIDTH)
                keys = band_keys(signature(items)).view(np.int64) if len(items) else np.zeros(0, dtype=np.int64)
                rows.append((did, th, len(items), *_digests(items), keys))
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], schema=out)

    return in_batches(_keyed(docs)).mapInArrow(sign, "did long, th long, n long, s1 long, s2 long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text). An id that many rows share (null among them) is no key of its own; with the text's hash it is."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")


def _digests(items: np.ndarray) -> tuple[int, int]:
    total = np.add.reduce(mix(items ^ _U(0x1234567)), dtype=np.uint64), np.add.reduce(mix(items + _U(0x89ABCDEF)), dtype=np.uint64)
    return tuple(int(np.array(x, dtype=np.uint64).view(np.int64)) for x in total)


def _sets(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items) for ``nodes`` (did, th, node): sorted shingle hashes as bytes, from whole texts (did, th, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(text.as_py(), WIDTH).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], names=["node", "items"])

    rows = keyed.join(nodes, ["did", "th"]).select("node", "text")
    return in_batches(rows).mapInArrow(build, "node long, items binary")


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed links of ``pairs`` (leader, node)."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("groups"))
    member = (
        pairs.join(sizes, "leader")
        .select("leader", "node", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("part"))
        .join(sets, "node")
        .select("leader", "part", "node", "items")
    )
    lead = (
        sizes.join(sets.withColumnRenamed("node", "leader"), "leader")
        .select("leader", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("part"), F.col("leader").alias("node"), "items")
    )
    spark = pairs.sparkSession
    together = member.unionByName(lead).repartition(partitions(spark), "leader", "part")
    # A leader is the least node of its group, so it comes first.
    together = together.sortWithinPartitions("leader", "part", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            us, vs = [], []
            for leader, part, node, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = np.frombuffer(items, dtype=np.uint64)
                if (leader, part) != at:
                    at, first = (leader, part), None
                if node == leader:
                    first = own
                elif first is not None and similar(first, own, percent):
                    us.append(node)
                    vs.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return in_batches(together).mapInArrow(confirm, "u long, v long")


def _prefixes(mine: DataFrame, percent: int) -> DataFrame:
    """(key, node, root, n): the rarest elements of each set of ``mine`` (node, root, items), by one order for all.

    Sets with 100 * |intersection| >= percent * |union| have at least percent * n / 100 elements in common, so of
    any order of all elements they share one of the first n - ceil(percent * n / 100) + 1 of each. The order here goes
    by counters that elements share by hash: exact whatever the counters say, and short where they are right.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for items in batch.column(0):
                total += np.bincount((np.frombuffer(items.as_buffer(), dtype=np.uint64) >> _U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["at", "n"])

    # One row for each counter: 2 ** COUNTER_BITS at most.
    rows = in_batches(mine.select("items")).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counters = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    for r in rows:
        counters[r["at"]] = r["n"]

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, lengths = [], [], []
            for items in batch.column(2):
                own = np.frombuffer(items.as_buffer(), dtype=np.uint64)
                order = np.lexsort((own, counters[(own >> _U(64 - COUNTER_BITS)).astype(np.int64)]))
                keys.append(own[order[: len(own) + percent * len(own) // -100 + 1]])
                sizes.append(len(keys[-1]))
                lengths.append(len(own))
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), batch.column(0).take(row), batch.column(1).take(row), pa.array(lengths, pa.int64()).take(row)], names=["key", "node", "root", "n"]
            )

    return in_batches(mine.select("node", "root", "items")).mapInArrow(rarest, "key long, node long, root long, n long")


def _mixed(member: DataFrame) -> DataFrame:
    """Keys of ``member`` (key, node, root, n) with more than one component: key, main (the component with the most
    classes), and the classes and elements of all and of those outside it. Of keys with the same classes one stays."""
    marks = [F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(1, node))").alias("y")]
    parts = member.groupBy("key", "root").agg(F.count("*").alias("classes"), F.sum("n").alias("elements"), *marks)
    whole = parts.groupBy("key").agg(
        F.max(F.struct("classes", "root", "elements")).alias("main"), F.sum("classes").alias("classes"), F.sum("elements").alias("elements"),
        F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"),
    ).where("classes > main.classes")
    whole = whole.select("key", F.col("main.root").alias("main"), "classes", "elements", F.expr("classes - main.classes").alias("others"), F.expr("elements - main.elements").alias("other_elements"), "x", "y")
    return whole.groupBy("x", "y", "classes", "elements").agg(F.min(F.struct("key", "main", "others", "other_elements")).alias("k")).select("k.*", "classes", "elements")


def _block_links(buckets: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components among the classes of those buckets (key, node, n) that hold more than one."""
    member = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    member = materialise(member.join(several, "key").select("key", "node", "root", "n"), "several")
    mixed = materialise(_mixed(member), "mixed")
    if mixed.isEmpty():
        drop(member, mixed)
        return None
    one_block = (F.col("others") <= GROUP) & (F.col("other_elements") <= GROUP_ITEMS)
    links = [materialise(_compared(member, mixed.where(one_block), sets, percent), "links")]
    wide = mixed.where(~one_block).select("key")
    if not wide.isEmpty():
        mine = materialise(member.join(wide, "key").select("node", "root").distinct().join(sets, "node"), "wide")
        prefix = materialise(_prefixes(mine, percent), "prefixes")
        still = materialise(_mixed(prefix), "mixed")
        links.append(materialise(_compared(prefix, still, mine.select("node", "items"), percent), "links"))
        drop(mine, prefix, still)
    out = materialise(reduce(DataFrame.unionByName, links), "links")
    drop(member, mixed, *links)
    return out


def _compared(member: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among the classes of ``member`` (key, node, root, n) of each key of ``mixed``."""
    parts = lambda classes, elements: F.ceil(F.greatest(F.col(classes) / GROUP, F.col(elements) / GROUP_ITEMS)).cast("int")
    dealt = member.join(mixed, "key").select("key", "node", "root", "main", parts("others", "other_elements").alias("rows"), parts("classes", "elements").alias("columns"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Classes outside the largest component are held in a block each, and all classes stream past all blocks.
    held = dealt.where("root <> main").select("key", "node", "root", part("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"))
    past = dealt.select("key", "node", "root", every("rows").alias("i"), part("columns").alias("j"), F.lit(1).alias("side"))
    together = held.unionByName(past).join(sets, "node").select("key", "i", "j", "side", "node", "root", "items")
    together = together.repartition(partitions(member.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            out = []
            for *group, side, node, root, items in zip(*(batch.column(c).to_pylist() for c in range(6)), batch.column(6), strict=True):
                if group != at:
                    at, block, parent = group, [], {}
                own = np.frombuffer(items.as_py(), dtype=np.uint64)
                if not side:
                    block.append((node, root, own))
                    continue
                for other, its, held in block:
                    if find(its) != find(root) and similar(held, own, percent):
                        parent[find(its)] = find(root)
                        out.append((max(node, other), min(node, other)))
            yield _links(out)

    return in_batches(together).mapInArrow(connect, "u long, v long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    us, vs = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """(did, th, n, component_id, stays) of every row: ``stays`` marks the rows of one (did, th) of each component."""
    signed = materialise(_signatures(docs), "signatures")
    some = signed.where("n > 0")
    classes = some.groupBy("n", "s1", "s2").agg(
        F.min(F.struct("did", "th")).alias("least"), F.min(F.when(F.col("did") != NULL_ID, F.col("did"))).alias("first")
    )
    classes = classes.select("n", "s1", "s2", F.col("least.did").alias("did"), F.col("least.th").alias("th"), "first")
    classes = materialise(with_ranks(classes, [F.col(c) for c in ("did", "th", "s1", "s2", "n")], "classes", "node"), "nodes")
    own = classes.select("n", "s1", "s2", "did", "th", "node")
    bands = some.dropDuplicates(["did", "th"]).join(own, ["n", "s1", "s2", "did", "th"])
    keyed = bands.select("node", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("last")).where("least.node < last")
    buckets = buckets.select("key", F.col("least.node").alias("leader"), F.col("least.n").alias("size"))
    member = materialise(keyed.join(buckets, "key"), "buckets")
    near = F.expr(f"100 * least(n, size) >= {percent} * greatest(n, size)")
    pairs = materialise(member.where((F.col("node") != F.col("leader")) & near).select("leader", "node").distinct(), "pairs")

    texts = _keyed(docs)
    if not some.groupBy("did", "th").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        texts = texts.dropDuplicates(["did", "th"])  # repeated rows would repeat their class's set
    sets = materialise(_sets(texts, own.join(member.select("node").distinct(), "node").select("did", "th", "node")), "sets")
    links = materialise(_star_links(pairs, sets, percent), "links")
    roots = connected_components(links)
    more = _block_links(member.select("key", "node", "n"), roots, sets, percent)
    drop(member, pairs, sets)
    if more is not None and not more.isEmpty():
        drop(roots)
        roots = connected_components(links.unionByName(more))
    drop(links, more)

    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nulls_last = F.struct((F.col("did") == NULL_ID).alias("none"), "did", "th")
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.min(nulls_last).alias("one"))
    component = placed.join(firsts, "root").select("n", "s1", "s2", "component_id", F.col("one.did").alias("did1"), F.col("one.th").alias("th1"))
    rows = signed.select("did", "th", "n", "s1", "s2").join(component, ["n", "s1", "s2"], "left")
    alone = F.col("n") == 0
    own = F.when(F.col("did") != NULL_ID, F.col("did"))
    return rows.select(
        "did", "th", "n", F.when(alone, own).otherwise(F.col("component_id")).alias("component_id"),
        (alone | ((F.col("did") == F.col("did1")) & (F.col("th") == F.col("th1")))).alias("stays"),
    )


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Rows link when 100 * |intersection| >= percent * |union| of their sets of distinct 5-word
    shingles (of a shorter text its whole word sequence). component_id is the smallest doc_id
    reachable. Null, empty and blank texts have no shingles and stand alone. Rows with a null
    doc_id take part; they never name a component, unless all its rows have none (then null, and
    they are kept). Repeated rows of the smallest doc_id are all kept. Other columns are ignored. An empty
    table gives an empty result.
    """
    doc_id = F.when(F.col("did") != NULL_ID, F.col("did"))
    out = _components(docs, percent).select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, with all columns whatever their names, less all but one row of each component.

    The row of the smallest doc_id stays (nulls last; of equal ids, that of the smaller text hash); of repeated
    rows with the same id and text one stays. Rows without shingles stand alone and all stay.
    """
    stays = _components(docs, percent).where("stays").groupBy("did", "th").agg(F.max("n").alias("n"), F.count("*").alias("k"))
    stays = materialise(stays, "stays")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), F.xxhash64("text").alias("th"))
    repeated = F.expr("n > 0 AND k > 1")
    out = rows.join(stays.where(~repeated), ["did", "th"], "left_semi")
    if not stays.where(repeated).isEmpty():
        out = out.unionByName(rows.join(stays.where(repeated), ["did", "th"], "left_semi").dropDuplicates(["did", "th"]))
    return out.select("row.*")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)
