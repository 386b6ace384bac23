"""Exact dedup by deterministic block naming, in DataFrame functions only.

The normalised text is cut into fixed-size byte blocks. The distinct blocks are sorted and
numbered; a document is then a sequence of integers. Adjacent pairs of integers are sorted and
numbered in turn, halving the sequence, until each document is one integer. Numbering is
one-to-one at every level, so two documents end with the same (level, integer) exactly when
their normalised texts are equal: no digest decides an equality.

Blocks cross the network once, to be sorted. Occurrences look their number up by a 64-bit
digest of the block, which the table of numbers has first proven to be unambiguous; blocks
whose digest two different blocks share are looked up by their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, documents, materialise

#: Bytes of a block. Most documents have one or two; the rounds are log2 of the longest text's blocks.
BLOCK = 4096


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _numbered(distinct: DataFrame, keys: list[str], keep: list[str], label: str) -> DataFrame:
    """Integers for distinct rows: sorted within each hash partition, numbered in that order.

    The staged table fixes the numbers, so a task that is run again cannot change them.
    """
    named = distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return materialise(named.select(*keep, "name"), label)


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """(did, sha, pos, digest, bytes) for every block of every row; an empty text has one empty block."""
    norm = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), normalised(F.col("text")).alias("norm"))
    whole = norm.select("did", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").cast("binary").alias("raw"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(block))).cast("int")
    at = whole.select("did", "sha", "raw", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    piece = F.substring("raw", F.col("pos") * block + 1, F.lit(block))
    return at.select("did", "sha", "pos", piece.alias("bytes")).withColumn("digest", F.xxhash64("bytes"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(did, sha, copies, level, name): one row per distinct (doc_id, normalised text), with how
    many rows have it and the identity of its normalised text."""
    blocks = _blocks(docs, block)
    distinct = blocks.groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    names = _numbered(distinct, ["bytes"], ["digest"], "blocks")
    shared = names.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    if shared.isEmpty():
        # The names' exchange stands right below the join, so that a hot block's side can be split.
        found = blocks.drop("bytes").join(names, "digest").select("did", "sha", "pos", "name")
    else:
        # Two different blocks share a digest: number those blocks anew, by their bytes.
        clear = materialise(names.join(shared, "digest", "left_anti"), "blocks")
        odd = blocks.join(shared, "digest", "left_semi")
        apart = odd.groupBy("bytes").agg(F.count("*").alias("n")).sortWithinPartitions("bytes")
        apart = materialise(apart.select("bytes", (-1 - F.monotonically_increasing_id()).alias("name")), "blocks")
        found = blocks.drop("bytes").join(clear, "digest").select("did", "sha", "pos", "name")
        found = found.unionByName(odd.join(apart, "bytes").select("did", "sha", "pos", "name"))
    state = materialise(
        found.groupBy("did", "sha")
        .agg(F.collect_set(F.struct("pos", "name")).alias("seq"), F.count_if(F.col("pos") == 0).alias("copies"))
        .select("did", "sha", "copies", F.transform(F.array_sort("seq"), lambda x: x["name"]).alias("seq")),
        "sequences",
    )
    level, done = 0, []
    while True:
        done.append(state.where(F.size("seq") == 1).select("did", "sha", "copies", F.lit(level).alias("level"), F.col("seq")[0].alias("name")))
        state = state.where(F.size("seq") > 1)
        if state.isEmpty():
            break
        level += 1
        state = _halved(state)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _halved(state: DataFrame) -> DataFrame:
    """Replace adjacent pairs by their numbers; a last odd element pairs with nothing (null)."""
    half = F.ceil(F.size("seq") / F.lit(2)).cast("int")
    pairs = state.select("did", "sha", "copies", "seq", F.explode(F.sequence(F.lit(0), half - 1)).alias("pos"))
    pairs = pairs.select("did", "sha", "copies", "pos", F.col("seq")[F.col("pos") * 2].alias("a"), F.get("seq", F.col("pos") * 2 + 1).alias("b"))
    names = _numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], ["a", "b"], "pairs")
    names = names.withColumnsRenamed({"a": "a2", "b": "b2"})
    found = pairs.join(names, (F.col("a") == F.col("a2")) & F.col("b").eqNullSafe(F.col("b2")))
    return materialise(
        found.groupBy("did", "sha", "copies")
        .agg(F.collect_list(F.struct("pos", "name")).alias("seq"))
        .select("did", "sha", "copies", F.transform(F.array_sort("seq"), lambda x: x["name"]).alias("seq")),
        "sequences",
    )


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; null counts
    as empty. The smallest doc_id of a group stays (nulls last). Repeated rows of that doc_id
    are told apart: one of them is kept. An empty table gives an empty result; other columns
    are not looked at.
    """
    each = materialise(identities(docs, block), "identities")
    groups = each.groupBy("level", "name").agg(
        F.sum("copies").alias("group_size"),
        F.min(F.when(F.col("did") != NULL_ID, F.col("did"))).alias("keep_id"),
    )
    rows = each.join(materialise(groups, "groups"), ["level", "name"])
    doc_id = F.when(F.col("did") != NULL_ID, F.col("did"))
    return rows.select(
        doc_id.alias("doc_id"), "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
