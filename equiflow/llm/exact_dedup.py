"""Exact duplicates by two Bloom passes.

Pass one marks, in a filter of two-state counters, every place that at least two rows hit. The
filter is built in slices: a task sends the places it has hit (each once, with a flag where it
hit one twice), so groups of copies of any size shrink before the shuffle. Pass two reads the
rows again; those with a place that nobody else hit cannot have a copy and pass straight
through. Only the rest is grouped, by SHA-256, so false positives cost time and nothing else.

The filter has 16 bits a row and at most ``max_bits`` (128 MB at the default, broadcast). With n rows
and m bits the part (1 - exp(-2n/m))^2 of the rows without a copy comes through all the same: 1.4 % at
16 bits a row (to 67 million rows), 5 % at 8, 15 % at 4, 40 % at 2 (540 million rows), 75 % at 1. They
are grouped like the others, so the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import SPACE, materialise

SLICES = 64
MAX_BITS = 1 << 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    low = np.uint64((1 << bits) - 1)
    return (u & low).astype(np.uint32), ((u >> np.uint64(32)) & low).astype(np.uint32)


def repeated_filter(hashes: DataFrame, rows: int, max_bits: int = MAX_BITS) -> tuple[int, bytes]:
    """(log2 of the number of bits, bitmap of the places hit at least twice) for one long column."""
    bits = max(16, min((max_bits - 1).bit_length(), (16 * max(rows, 1) - 1).bit_length()))
    per = max(1, (1 << bits) // SLICES)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            place, count = np.unique(np.concatenate(_places(h, bits)), return_counts=True)
            edge = np.searchsorted(place, np.arange(SLICES + 1, dtype=np.uint64) * per)
            keep = [i for i in range(SLICES) if edge[i] < edge[i + 1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keep, pa.int32()),
                    pa.array([place[edge[i] : edge[i + 1]].tobytes() for i in keep], pa.binary()),
                    pa.array([np.packbits(count[edge[i] : edge[i + 1]] > 1).tobytes() for i in keep], pa.binary()),
                ],
                names=["slice", "places", "twice"],
            )

        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False))
                n += b.num_rows
            if n >= 2_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        start = key[0].as_py() * per
        once, twice = np.zeros(per, bool), np.zeros(per, bool)
        for data, flags in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True):
            at = np.frombuffer(data, np.uint32) - np.uint32(start)
            twice[at] |= once[at] | np.unpackbits(np.frombuffer(flags, np.uint8), count=len(at)).astype(bool)
            once[at] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    slices = hashes.mapInArrow(hit, "slice int, places binary, twice binary").groupBy("slice").applyInArrow(merge, "slice int, bitmap binary")
    out = bytearray((per * SLICES) // 8)
    for r in slices.collect():  # at most SLICES rows and max_bits / 8 bytes in all
        out[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = r["bitmap"]
    return bits, bytes(out)


def possibly_repeated(docs: DataFrame, text: Column, max_bits: int = MAX_BITS) -> Column:
    """A boolean column: false only where no other row has an equal text."""
    key = F.xxhash64(text)
    bits, bitmap = repeated_filter(docs.select(key.alias("h")), docs.count(), max_bits)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    @pandas_udf("boolean")
    def might(h: pd.Series) -> pd.Series:
        seen = np.frombuffer(held.value, np.uint8)
        a, b = _places(h.to_numpy(), bits)
        return pd.Series(((seen[a >> 3] >> (7 - (a & 7))) & (seen[b >> 3] >> (7 - (b & 7))) & 1).astype(bool))

    return might(key)


def exact_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the smallest doc_id stays, a null doc_id only if no
    other is there; of rows repeated with that doc_id one stays. Other columns are ignored, so
    their names may clash with ours. An empty table gives no rows.
    """
    text = normalised(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(text, 256).alias("text_sha256"),
        possibly_repeated(docs, text, max_bits).alias("maybe"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows)
    some = rows.filter("maybe")
    group = some.groupBy("text_sha256").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size")
    )
    # at most 512 groups can be as large as that, so they fit a broadcast whatever the input
    large = max(1000, rows.count() // 512)
    group = materialise(group)
    hot = F.broadcast(group.filter(F.col("group_size") > large).selectExpr("text_sha256", "first AS f1", "group_size AS n1"))
    rest = group.filter(F.col("group_size") <= large).selectExpr("text_sha256 AS key", "first AS f2", "group_size AS n2")
    known = (
        some.join(hot, "text_sha256", "left")
        .withColumn("key", F.when(F.col("n1").isNull(), F.col("text_sha256")).otherwise(F.col("row").cast("string")))
        .join(rest, "key", "left")
        .withColumn("first", F.coalesce("f1", "f2"))
        .select("doc_id", F.col("first.doc_id").alias("keep_id"), F.coalesce("n1", "n2").alias("group_size"), (F.col("first.row") == F.col("row")).alias("kept"), "text_sha256")
    )
    alone = rows.filter("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(known)


def drop_exact_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, without later copies; only possible copies are moved.

    Null texts count as empty, so one row of all empty texts stays; of equal texts the smallest doc_id
    stays, a null one only if no other is there, and one of rows repeated with it. An empty table gives
    no rows.
    """
    columns = docs.columns
    text = normalised(F.col("text"))
    maybe = possibly_repeated(docs, text, max_bits)
    packed = docs.select(F.struct(*columns).alias("all"), F.col("doc_id").alias("id"), F.col("text"), maybe.alias("maybe"))
    some = materialise(packed.filter("maybe").select("all", "id", F.sha2(text, 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    first = some.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    kept = some.join(first, "row", "left_semi")
    return packed.filter("NOT maybe").select("all.*").unionByName(kept.select("all.*"))
