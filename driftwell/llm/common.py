"""Helpers the corpus operators share: staging tables, distributed ranks, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.staging import drop as drop  # noqa: PLC0414
from driftwell.staging import stage as materialise

#: Stands in for a null doc_id inside the operators, so that it joins and sorts; it never leaves them.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_ranks(df: DataFrame, order: list[Column], label: str, out: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    One range exchange and a sort inside each partition; the staged table fixes what each row
    drew, and the driver only adds up one count per partition. No task sees more than its range.
    """
    spark = df.sparkSession
    # Rows equal in ``order`` are told apart by where they come from, so that any number of them is dealt out evenly.
    order = [*order, F.col("_tie")]
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    staged = materialise(ordered, label)
    part = F.shiftright("_at", 33)
    counts = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    before, starts = 0, []
    for row in sorted(counts, key=lambda r: r["_part"]):
        starts.append((row["_part"], before))
        before += row["_n"]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part long, _before long")
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of the staged table
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def chosen_rows(rows: DataFrame, cls: str, per_class: int, total: int, max_bytes: int) -> tuple[list[tuple[int, int, object]], dict]:
    """A sample of the distinct (did, th) of ``rows`` (did, th, bytes, ``cls``), and the rows of each class.

    Rows are taken in order of a hash of did and th, so a repeated doc_id with different texts is sampled row by
    row. Each class gives at most ``per_class`` rows and its even share of ``total`` rows (one at least) and of
    ``max_bytes`` bytes; a text that does not fit into what is left of that share is passed over. Only hashes below
    a bound reach the driver: some four times as many short rows as are wanted, whatever the size of the table.
    """
    counts = rows.groupBy(cls).agg(F.count("*").alias("n")).collect()
    sizes = {r[cls]: r["n"] for r in counts}
    if not sizes:
        return [], {}
    per_class = min(per_class, max(total // len(sizes), 1))
    max_bytes //= len(sizes)
    span = 1 << 30
    draw = F.pmod(F.xxhash64("did", "th"), F.lit(span))
    bounds = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(span, 4 * per_class * span // max(n, 1) + 1))])
    near = rows.where(draw < F.element_at(bounds, F.col(cls))).select(draw.alias("_draw"), "did", "th", "bytes", cls).distinct().collect()
    taken: dict = {}
    out = []
    for _, did, th, size, c in sorted(near):
        n, held = taken.get(c, (0, 0))
        if n < per_class and held + size <= max_bytes:
            taken[c] = (n + 1, held + size)
            out.append((did, th, c))
    return out, sizes


def texts_of(docs: DataFrame, chosen: list[tuple[int, int, object]], kind: str) -> list[tuple[str, object]]:
    """(text, class) of the ``chosen`` (did, th, class), in order of did and text: one row for each of them."""
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, f"did long, th long, _c {kind}")
    keyed = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), "text")
    # As many rows as the sample has, which is bounded; copies of a row fall together before they leave a task.
    rows = keyed.join(F.broadcast(wanted), ["did", "th"]).groupBy("did", "th", "_c").agg(F.first("text").alias("text")).collect()
    return [(r["text"], r["_c"]) for r in sorted(rows, key=lambda r: (r["did"], r["text"], r["_c"]))]


def in_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df`` as it is; Arrow batches of the session are held to ``rows`` rows, so that a Python worker
    has few long texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def known_labels(labels: DataFrame, label: str, *, folds: int, held_out: int) -> DataFrame:
    """(did, _y), staged, of the labels outside the held-out fold. A doc_id labelled more than once counts by its mean,
    halves up; null labels are ignored."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy(F.col("doc_id").alias("did"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    )
    return materialise(known, "labels")  # so that joins with it have plain exchanges, which AQE splits


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, per_class: int, max_bytes: int
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most ``per_class`` learning rows of each class (``max_bytes`` bytes in all), and how many
    learning rows there are of each.

    Learning rows are those of ``docs`` that have a label, a text and an id whose ``fold`` is not ``held_out``; labels
    of absent documents count for nothing; see ``known_labels``. The rows are few, so they may be broadcast and collected.
    """
    known = known_labels(labels, label, folds=folds, held_out=held_out)
    usable = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("bytes"))
    rows = materialise(usable.join(known, "did"), "labelled")
    chosen, sizes = chosen_rows(rows, "_y", per_class, 2 * per_class, max_bytes)
    drop(known, rows)
    return texts_of(docs, chosen, "int"), sizes
