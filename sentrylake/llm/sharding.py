"""Shards of near-equal bytes along a sort key, cut at quantiles of a size-weighted sample."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.session import materialize

#: Bytes that a range should have, and the most ranges there are: what the driver and a task's cuts can grow to.
RANGE_BYTES, MOST_RANGES = 1 << 20, 1 << 16
#: Draws of the sample for each range.
DRAWS = 8
#: A range of more than one row is overfull beyond this many times its due, and is cut again at draws of its own.
OVERFULL = 2.0


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8 plus 8 for its id; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _sample(rows: DataFrame, per_byte: Column) -> dict[int, list[tuple[tuple, int]]]:
    """Keys with their draws in ascending order, by range; a row is drawn ``size * per_byte`` times on average.

    The chance comes from a hash of the key, so a task that runs again draws the same.
    """
    chance = F.pmod(F.xxhash64("sk", F.lit(17)), F.lit(1 << 32)).cast("double") * 2.0**-32
    drawn = rows.select("part", "sk", F.floor(F.col("size") * per_byte + chance).alias("draws")).where("draws > 0")
    found: dict[int, list[tuple[tuple, int]]] = {}
    for part, sk, draws in drawn.orderBy("part", "sk").collect():
        found.setdefault(part, []).append((tuple(sk), draws))
    return found


def _cuts(sample: list[tuple[tuple, int]], n: int) -> list[tuple]:
    """Keys at the ``n - 1`` inner quantiles of a weighted sample; fewer where one key fills several."""
    total, upto, cuts = sum(draws for _, draws in sample), 0, []
    for key, draws in sample:
        upto += draws
        reached = min(n - 1, upto * n // total)
        if reached > len(cuts):
            cuts += [key] * (reached - len(cuts))
    return sorted(set(cuts))


def _part_of(cuts: list[tuple]) -> Column:
    """The number of cuts below a row's key: a row that equals a cut is in the range that this cut ends."""

    @F.pandas_udf("int")
    def number(known: pd.Series, k: pd.Series, tie: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_left(cuts, key) for key in zip(known, k, tie, salt, strict=True)], dtype="int32")

    return number("sk.known", "sk.k", "sk.tie", "sk.salt")


def _measured(rows: DataFrame, cuts: list[tuple]) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range; one row for each range reaches the driver."""
    found = rows.groupBy(_part_of(cuts).alias("part")).agg(F.sum("size"), F.count("*")).collect()
    return {part: (size, n) for part, size, n in found}


def shard_by_bytes(records: DataFrame, n_shards: int, key: str = "doc_id", size: str = "size", range_bytes: int = RANGE_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """All columns of ``records``, and ``shard`` and ``slot``: rows in order of the key fill shards of equal bytes.

    A row is in shard ``floor(bytes before it * n_shards / all bytes)``, so the bytes of two shards differ
    by a row's at most; ``slot`` counts the rows of a shard from 0. What is before a row is what the ranges
    before its own have, which are measured, and what is before it in its range. The ranges are cut at
    quantiles of a sample that draws keys by size; ranges that turn out overfull are cut again, until none
    is left that can be.

    A hot key is no matter: rows of one key follow a hash of their other columns, and rows alike in all
    columns a number that they get when they are first written, so any range can be cut. Null keys come
    first, a null size counts 0. Columns are taken by position, extra ones are carried along.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard")
    spark, names = records.sparkSession, records.columns
    plain = records.toDF(*[f"c{i}" for i in range(len(names))])
    k = plain[f"c{names.index(key)}"]
    # without nulls, and texts as their bytes in hexadecimal, so that Python and Spark order keys alike
    value = F.coalesce(k.cast("long"), F.lit(0)) if plain.schema[f"c{names.index(key)}"].dataType.typeName() in ("long", "integer", "short", "byte") else F.coalesce(F.hex(k.cast("string").cast("binary")), F.lit(""))
    salt = F.xxhash64(F.monotonically_increasing_id())
    sk = F.struct(k.isNotNull().cast("int").alias("known"), value.alias("k"), F.xxhash64(*plain.columns).alias("tie"), salt.alias("salt"))
    rows = materialize(plain.select("*", F.coalesce(plain[f"c{names.index(size)}"].cast("long"), F.lit(0)).alias("size"), sk.alias("sk"), F.lit(0).alias("part")), "shard-rows")

    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = min(most_ranges, max(1, total // range_bytes))
    due = max(1.0, total / ranges)
    cuts = [c for own in _sample(rows, F.lit(DRAWS / due)).values() for c in _cuts(own, ranges)]
    while True:
        measured = _measured(rows, cuts)
        full = {part: n for part, (n, count) in measured.items() if n > OVERFULL * due and count > 1}
        inside = rows.withColumn("part", _part_of(cuts)).where(F.col("part").isin(list(full))) if full else None
        more = [c for part, own in _sample(inside, F.lit(4 * DRAWS / due)).items() for c in _cuts(own, int(2 * full[part] / due))] if full else []
        if not set(more) - set(cuts):
            break
        cuts = sorted({*cuts, *more})

    bases, bytes_before, rows_before = [], 0, 0
    for part in sorted(measured):
        bases.append((part, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + measured[part][0], rows_before + measured[part][1]
    # at most twice most_ranges rows and those of cut ranges, hence a broadcast of a known size
    base = F.broadcast(spark.createDataFrame(bases, "part int, bytes_before long, rows_before long"))
    w = Window.partitionBy("part").orderBy("sk").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("part", _part_of(cuts)).withColumn("own_bytes", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("own_rows", F.count("size").over(w))
    placed = placed.join(base, "part").withColumn("row", F.col("rows_before") + F.col("own_rows"))
    before = (F.col("bytes_before") + F.col("own_bytes")).cast("decimal(28,0)") * F.lit(n_shards)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(before / F.lit(max(1, total)).cast("decimal(20,0)")).cast("int")))
    placed = materialize(placed.select(*plain.columns, "shard", "row"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(placed: DataFrame, folder: str) -> None:
    """The rows of each shard as Parquet files in a folder of its own, in the order of their slots.

    A shard is as many tasks as it needs, of a million slots each; their file names don't order them, ``slot`` does.
    """
    block = F.floor(F.col("slot") / 1_000_000)
    placed.repartition(F.col("shard"), block).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)
