"""SpotSigs fingerprints: chains of content words behind common words, with SQL functions only.

A spot is a common word (the anchor) with the next ``CHAIN`` content words after it. The set of a
text's spots, hashed, is its fingerprint. Boilerplate seldom has natural sentences, so it adds few
spots; the set follows the running prose.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of

# Common function words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "au aux dans de des du elle en est et il la le les mais ne on ou par pas pour qui que sur un une "
    "als auch auf das dem den der des die ein eine er es im ist mit nicht sich und von zu "
    "al como con del el ella lo los las no o para pero por se sin su una y"
).split()
CHAIN = 2
WORDS = r"[\p{L}\p{N}]+"


def with_spots(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the sorted distinct 64-bit hashes of the spots of column ``text`` (a column out is replaced).

    A text without any spot (empty, null, no common word) has one that stands for its whole
    word sequence, so equal texts have equal fingerprints and no fingerprint is empty.
    """
    w, c, p = (next(n for n in (f"_{out}_{k}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for k in "wcp")
    anchors = F.array(*[F.lit(a) for a in dict.fromkeys(ANCHORS)])
    df = df.withColumn(w, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0)))
    # one string of flags, then positions of content words: each pass is linear in the text
    df = df.withColumn(p, F.expr(f"filter(transform({w}, (x, i) -> if(x IN ({', '.join(repr(a) for a in dict.fromkeys(ANCHORS))}), -1, i)), i -> i >= 0)"))
    df = df.withColumn(c, F.expr(f"transform({p}, i -> {w}[i])"))
    spot = F.expr(
        f"""flatten(transform({p}, (at, k) ->
              if(k + {CHAIN} > size({p}) OR at = if(k = 0, 0, {p}[k - 1] + 1), CAST(array() AS array<bigint>),
                 transform(slice({w}, if(k = 0, 0, {p}[k - 1] + 1) + 1, at - if(k = 0, 0, {p}[k - 1] + 1)),
                           a -> xxhash64(a, {", ".join(f"{c}[k + {j}]" for j in range(CHAIN))})))))"""
    )
    df = df.withColumn(out, F.array_sort(F.array_distinct(spot)))
    whole = F.array(F.xxhash64(F.concat_ws(" ", F.col(w)), F.lit("whole")))
    return df.withColumn(out, F.when(F.size(out) == 0, whole).otherwise(F.col(out))).drop(w, c, p)


def fingerprint(spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two spot sets, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def length_part(spots: Column, least: float) -> Column:
    """Number of the set's length range; only sets of one range or of neighbours can reach ``least``."""
    return F.floor(F.log(F.size(spots).cast("double")) / (-math.log(least) * 1.0001)).cast("int")


def pruned_likeness(a: Column, b: Column, least: float) -> Column:
    """Jaccard similarity, 0 where it is below ``least``.

    Sets are compared only where their length ranges and then their lengths leave that possible.
    """
    apart = (F.abs(length_part(a, least) - length_part(b, least)) > 1) | (F.least(F.size(a), F.size(b)) < least * F.greatest(F.size(a), F.size(b)))
    return F.when(apart, F.lit(0.0)).when(likeness(a, b) >= least, likeness(a, b)).otherwise(F.lit(0.0))


def spot_links(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (left, right, similarity) of fingerprint classes with similarity >= threshold.

    df: doc_id and spots. Equal fingerprints are one class, named by its smallest doc_id (see
    ``spot_classes``). Classes are partitioned by set length, so that only equal or neighbouring
    length ranges can hold a pair; within those, a pair must share one of the first
    (1 - threshold) * length + 1 hashes, and size bounds prune before sets are compared. Null ids
    count as one more id, repeated ones as one; an empty table gives no pairs. Pairs that share a
    spot are listed, so a spot that very many classes of like length have is costly.
    """
    sets = spot_classes(df).groupBy("class_id").agg(F.first("spots").alias("spots")).withColumn("n", F.size("spots"))
    sets = sets.withColumn("part", length_part(F.col("spots"), threshold))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1
    keyed = sets.select("class_id", "n", "part", F.explode(F.slice("spots", F.lit(1), prefix.cast("int"))).alias("spot"))
    left = keyed.select("spot", F.col("class_id").alias("left"), F.col("n").alias("n1"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = keyed.select("spot", F.col("class_id").alias("right"), F.col("n").alias("n2"), "part")
    pairs = left.join(right, ["spot", "part"]).filter((F.col("left") < F.col("right")) & (F.least("n1", "n2") >= threshold * F.greatest("n1", "n2"))).select("left", "right").distinct()
    a = sets.select(F.col("class_id").alias("left"), F.col("spots").alias("a"))
    b = sets.select(F.col("class_id").alias("right"), F.col("spots").alias("b"))
    return pairs.join(a, "left").join(b, "right").withColumn("similarity", likeness(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold).select("left", "right", "similarity")


def spot_classes(df: DataFrame) -> DataFrame:
    """doc_id, spots, class_id of every row: the smallest doc_id with an equal fingerprint, null if none has one."""
    keyed = df.withColumn("fp", F.xxhash64("spots"))
    return keyed.join(keyed.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "fp").drop("fp")


def with_next(docs: DataFrame, *, rows_per_bucket: int = 256, max_cuts: int = 1024) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in descending doc_id, after the last the first.

    Null ids come after all others; rows with one id are ordered by their texts. Rows are dealt
    into ranges of ids at approximate quantiles (their number is bounded, so the driver holds
    few), a range of more than ``rows_per_bucket`` rows is split evenly into 64 at most, and the first
    row of each range also goes, as a guest, to the range before it. So every text moves once. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 62)))
    n = docs.count()
    wanted = min(max_cuts, n // rows_per_bucket)
    probabilities = [i / wanted for i in range(wanted + 1)] if wanted > 1 else [0.0, 1.0]
    cuts = sorted({int(x) for x in (rows.filter("doc_id IS NOT NULL").approxQuantile("doc_id", probabilities, 0.25 / max(wanted, 1)) or [0])})
    split = max(1, min(64, n // (rows_per_bucket * max(1, len(cuts)))) if wanted == max_cuts else 1)
    cell = bucket_of(order, cuts)
    if split > 1:
        low, high = F.array(*[F.lit(x) for x in [cuts[0] - 1, *cuts]]), F.array(*[F.lit(x) for x in [*cuts, cuts[-1] + 1]])
        at = F.floor((order - F.get(low, cell)).cast("double") * split / F.greatest(F.lit(1), F.get(high, cell) - F.get(low, cell)))
        cell = cell * split + F.least(F.lit(split - 1), F.greatest(F.lit(0), at)).cast("int")
    rows = rows.withColumn("bucket", cell)
    heads = [(r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max(order).alias("head")).collect()]  # at most 64 * (max_cuts + 1) small rows
    heads.sort(reverse=True)
    spark = docs.sparkSession
    guests = [(head, heads[(i - 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    guest = F.broadcast(spark.createDataFrame(guests, "head long, home int"))
    moved = rows.join(guest, order == F.col("head")).select("doc_id", "text", F.col("home").alias("bucket"), F.lit(1).alias("guest"))
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(moved)
    from pyspark.sql import Window

    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return both.withColumn("next_text", F.lead("text").over(w)).filter("guest = 0").select("doc_id", "text", "next_text")
