"""Mixing sources to target weights with exact quotas, in DataFrame operations only.

Texts are cut into blocks of at most ``block_words`` words. A source's blocks are permuted by a
keyed digest, pass after pass, and its quota is a prefix of that order (the last block is cut, so
the words are exact). How many of a source's blocks each output shard gets is drawn by a tree of
multivariate hypergeometric splits over the shards; a shard then draws the next disjoint run of
each source's permuted blocks and shuffles what it has. The tree so decides which shard holds which
words of a document, and in what place; the mix comes out in that order.

Ranks inside a source and places inside a shard come from digest ranges of about ``bin_blocks``
blocks each, so a source with a third of all rows is spread like any other, and a shard of any size
is shuffled by many tasks. The driver holds one number per source and per (source, shard) only.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources are weighed in code point order, null last. What one source can't take is shared by
    weight among the others until none is above its limit: with sources in order of limit over
    weight that is the first level at which the next source is not full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one small row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("limit", F.col("source_size").cast("double") * most)
    every = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn(
        "level",
        (F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct(F.col("limit") / F.col("w"), "level"))).over(every)["level"]
    return by.withColumn("target", F.least("limit", F.coalesce(level * F.col("w"), F.col("limit")))).select("source", "source_size", "target")


def uniform(seed: int, node: int, source: int) -> float:
    """The number in [0, 1) that a node of the tree draws with for a source."""
    return int(hashlib.md5(f"{seed}|{node}|{source}".encode()).hexdigest()[:13], 16) / 2**52


def hypergeometric(u: float, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items taken without replacement are good: inversion of u over the mean +- 12 deviations."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    n = good + bad
    mean = drawn * good / n
    wide = 12 * math.sqrt(mean * (bad / n) * ((n - drawn) / max(1, n - 1))) + 1
    low, high = max(low, math.floor(mean - wide)), min(high, math.ceil(mean + wide))
    lg = math.lgamma
    log = lambda k: -lg(k + 1) - lg(good - k + 1) - lg(drawn - k + 1) - lg(bad - drawn + k + 1)
    top = log(min(high, max(low, math.floor(mean))))
    weights = [math.exp(log(k) - top) for k in range(low, high + 1)]
    left = u * sum(weights)
    for k, w in zip(range(low, high + 1), weights, strict=True):
        left -= w
        if left <= 0:
            return k
    return high


def split_tree(quotas: list[int], shards: int, seed: int, node: int = 1) -> list[list[int]]:
    """quotas[source] -> counts[shard][source]; shards get equal totals, at most one block apart."""
    if shards == 1:
        return [quotas]
    left, total = shards // 2, sum(quotas)
    need, rest, part = total * left // shards, total, []
    for i, q in enumerate(quotas):
        x = hypergeometric(uniform(seed, node, i), q, rest - q, need)
        part.append(x)
        need, rest = need - x, rest - q
    other = [q - x for q, x in zip(quotas, part, strict=True)]
    return split_tree(part, left, seed, 2 * node) + split_tree(other, shards - left, seed, 2 * node + 1)


def place_blocks(
    docs: DataFrame, *, block_words: int = 1024, shard_blocks: int = 256, shards: int = 256, bin_blocks: int = 1000, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size and target, placements).

    Placements: shard, position, doc_id, source, size, copy, pass, block, first_word, taken.
    ``shards`` is how many shards the mix has; a small one has as many as there are ``shard_blocks``
    in it. ``copy`` tells rows apart that share doc_id, source and size. Null texts have size 0 and
    are never taken; null sources are one source; other columns are ignored; an empty table
    gives empty tables.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"))
    sized = materialise(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"))
    targets = materialise(source_targets(sized))
    sized = _with_targets(sized, targets)
    blocks = (
        sized.filter("size > 0 AND target > 0")
        .withColumn("quota", F.floor(F.col("target") + 0.5))
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("source_size")).cast("int"))))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words))))
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
        .withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string"), F.col("block").cast("string"), F.col("pass").cast("string"))))
    )
    total = sized.agg(F.sum(F.ceil(F.col("size") / block_words))).first()[0] or 0
    digits = max(1, min(7, math.ceil(math.log(max(2, total / bin_blocks), 16))))
    blocks = blocks.withColumn("bin", F.substring("key", 1, digits))
    in_order = ["pass", "bin"]
    bins = blocks.groupBy("source", *in_order).agg(F.sum("words").alias("w"), F.count("*").alias("k"))
    before = Window.partitionBy("source").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), *in_order, F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("s", "z", *in_order).orderBy("key", "doc_id")
    ranked = (
        blocks.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("z", F.col("source").isNull())
        .withColumn("w1", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("k1", F.row_number().over(inside) - 1)
        .join(bins, ["s", "z", *in_order])
        .withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("quota") - F.col("w0") - F.col("w1"))))
        .filter("taken > 0")
        .select("doc_id", "source", "size", "copy", "pass", "block", (F.col("block") * block_words).alias("first_word"), "taken", "s", "z", (F.col("k0") + F.col("k1")).alias("rank"), "key")
    )
    ranked = materialise(ranked)
    per_source = sorted((r["z"], r["s"], r["k"]) for r in ranked.groupBy("s", "z").agg(F.count("*").alias("k")).collect())
    placed_blocks = sum(r[2] for r in per_source)
    shards = max(1, min(shards, -(-placed_blocks // shard_blocks)))
    counts = split_tree([r[2] for r in per_source], shards, seed)
    runs = []
    for i, (z, s, _) in enumerate(per_source):
        at = 0
        for shard in range(shards):
            at += counts[shard][i]
            runs.append((s, z, shard, at - counts[shard][i], at))
    spark = docs.sparkSession
    cuts = spark.createDataFrame(runs, "s string, z boolean, shard int, lo long, hi long").groupBy("s", "z").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "hi"))), lambda e: e["hi"]).alias("ends"))
    # the shard is the number of ends up to the rank, by bisection
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(shards.bit_length()))])
    shard = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= shards) & (F.get("ends", F.least(at + step, F.lit(shards)) - 1) <= F.col("rank")), at + step).otherwise(at))
    # a row a source, ``shards`` numbers each
    drawn = ranked.join(F.broadcast(cuts), ["s", "z"]).withColumn("shard", shard).drop("ends")
    digits = max(1, min(7, math.ceil(math.log(max(2, placed_blocks / shards / bin_blocks), 16))))
    drawn = drawn.withColumn("order", F.reverse("key")).withColumn("tray", F.substring("order", 1, digits))
    trays = drawn.groupBy("shard", "tray").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("tray").rowsBetween(Window.unboundedPreceding, -1)
    trays = trays.select("shard", "tray", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "tray").orderBy("order", "doc_id", "pass", "block")
    placements = drawn.withColumn("n", F.row_number().over(inside)).join(trays, ["shard", "tray"]).withColumn("position", F.col("first") + F.col("n"))
    return sized, placements.select("shard", "position", "doc_id", "source", "size", "copy", "pass", "block", "first_word", "taken")


def _with_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    return sized.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken, shards.

    shards says where its words are: ``shard:words``, by shard, comma-joined; empty if none are taken.
    See ``place_blocks`` for nulls, repeated rows and empty tables.
    """
    sized, placements = place_blocks(docs, **options)
    key = ["doc_id", "source", "size", "copy"]
    got = placements.groupBy(*key, "shard").agg(F.sum("taken").alias("w"))
    got = got.groupBy(*key).agg(F.sum("w").alias("taken"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shard", "w"))), lambda x: F.concat_ws(":", x["shard"], x["w"])), ",").alias("shards"))
    a, b = sized.alias("a"), got.alias("b")
    joined = a.join(b, (F.col("a.copy") == F.col("b.copy")) & (F.col("a.size") == F.col("b.size")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return joined.select("a.doc_id", "a.size", "source_size", "target", F.coalesce("b.taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("b.shards", F.lit("")).alias("shards"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the shards draw them, with the columns of docs; runs of places of a shard are in order in a partition.

    A row for what a shard draws of a document in a pass: its text as it is where that is all of it,
    else the drawn blocks in text order, at the place of the first of them. n_chars, where there is
    one, follows the text. Documents that are not taken (null and empty texts among them) have no row;
    null ids and sources count as values; rows that share id, source and size get the placements of one
    each; an empty table gives no rows.
    """
    _, placements = place_blocks(docs, **options)
    columns = docs.columns
    keys = lambda i, s: [F.coalesce(i, F.lit(0)).alias("i"), i.isNull().alias("no_i"), F.coalesce(s, F.lit("")).alias("s"), s.isNull().alias("no_s")]
    key = ["i", "no_i", "s", "no_s", "words"]
    runs = placements.groupBy("doc_id", "source", "size", "copy", "pass", "shard").agg(F.sort_array(F.collect_list(F.struct("first_word", "taken"))).alias("runs"), F.sum("taken").alias("drawn"), F.min("position").alias("position"))
    runs = runs.groupBy(*keys(F.col("doc_id"), F.col("source")), F.col("size").alias("words")).agg(F.collect_list(F.struct("copy", "shard", "position", "runs", "drawn")).alias("all_runs"))
    full = docs.select(F.struct(*columns).alias("all"), *keys(F.col("doc_id").cast("long"), F.col("source").cast("string")), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    copy = Window.partitionBy(*key).orderBy(F.xxhash64("all"))
    joined = full.join(runs, key).withColumn("mine", F.row_number().over(copy)).withColumn("one", F.explode(F.filter("all_runs", lambda x: x["copy"] == F.col("mine"))))
    pieces = F.regexp_extract_all(F.col("all.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    joined = joined.withColumn(
        "cut",
        F.when(F.col("one.drawn") == F.col("words"), F.col("all.text")).otherwise(
            F.rtrim(F.array_join(F.flatten(F.transform("one.runs", lambda r: F.slice(pieces, (r["first_word"] + 1).cast("int"), r["taken"].cast("int")))), ""))
        ),
    )
    out = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    cut = joined.select("one.shard", "one.position", F.struct(*[out.get(c, F.col("all")[c]).alias(c) for c in columns]).alias("row"))
    # runs of a shard's places go together; their ranges are known, so nothing is sampled
    run = F.floor(F.col("position") / options.get("bin_blocks", 1000))
    return cut.repartition("shard", run).sortWithinPartitions("shard", "position").select("row.*")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM s WINDOW f AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(level, lim / w) FROM l WHERE level <= lim / w) * w, lim)) AS target FROM l
), e AS (
  SELECT c.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, unnest(range(1, 1 + CAST(ceil(quota / source_size) AS BIGINT))) AS pass FROM e WHERE size > 0 AND target > 0),
b AS (SELECT *, unnest(range(0, 1 + (size - 1) // 1024)) AS block FROM p),
k AS (
  SELECT *, least(1024, size - block * 1024) AS words,
    md5(concat_ws('|', '7', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), size, copy, block, pass)) AS key FROM b
), r AS (
  SELECT *, greatest(0, least(words, quota - (sum(words) OVER (PARTITION BY source ORDER BY pass, key, doc_id ROWS UNBOUNDED PRECEDING) - words))) AS got,
    row_number() OVER (PARTITION BY source ORDER BY pass, key, doc_id) - 1 AS rank FROM k
), n AS (SELECT source, CAST(count(*) AS BIGINT) AS blocks, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM r WHERE got > 0 GROUP BY source),
top AS (SELECT CAST(sum(blocks) AS BIGINT) AS total, CAST(greatest(1, least(256, (sum(blocks) + 255) // 256)) AS BIGINT) AS shards, list(blocks ORDER BY nr) AS quotas FROM n),
tree(node, first, shards, quotas, i, need, rest, part) AS (
  SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), shards, quotas, CAST(1 AS BIGINT), CAST(total * (shards // 2) // shards AS BIGINT), total, CAST([] AS BIGINT[]) FROM top
  UNION ALL
  SELECT CASE WHEN i <= len(quotas) THEN node ELSE 2 * node + side END, CASE WHEN i <= len(quotas) OR side = 0 THEN first ELSE first + shards // 2 END,
    CASE WHEN i <= len(quotas) THEN shards WHEN side = 0 THEN shards // 2 ELSE shards - shards // 2 END, CASE WHEN i <= len(quotas) THEN quotas ELSE child END,
    CASE WHEN i <= len(quotas) THEN i + 1 ELSE 1 END,
    CASE WHEN i <= len(quotas) THEN need - x ELSE CAST(list_sum(child) AS BIGINT) * (CASE WHEN side = 0 THEN shards // 2 ELSE shards - shards // 2 END // 2) // CASE WHEN side = 0 THEN shards // 2 ELSE shards - shards // 2 END END,
    CASE WHEN i <= len(quotas) THEN rest - quotas[i] ELSE CAST(list_sum(child) AS BIGINT) END, CASE WHEN i <= len(quotas) THEN list_append(part, x) ELSE CAST([] AS BIGINT[]) END
  FROM (
    SELECT *, CASE WHEN i > len(quotas) OR a = z THEN a ELSE least(z, a + len(list_filter(range(1, len(weights) + 1), lambda j: list_sum(weights[1:j]) < u * list_sum(weights)))) END AS x,
      CASE WHEN side = 0 THEN part ELSE list_transform(range(1, len(quotas) + 1), lambda j: quotas[j] - part[j]) END AS child
    FROM (
      SELECT *, list_transform(range(a, z + 1), lambda q: exp(
          lgamma(m + 1) + lgamma(good - m + 1) + lgamma(need - m + 1) + lgamma(bad - need + m + 1)
          - lgamma(q + 1) - lgamma(good - q + 1) - lgamma(need - q + 1) - lgamma(bad - need + q + 1))) AS weights
      FROM (
        SELECT *, CAST(least(z, greatest(a, floor(mean))) AS BIGINT) AS m FROM (
          SELECT *, CAST(greatest(lo, floor(mean - wide)) AS BIGINT) AS a, CAST(least(hi, ceil(mean + wide)) AS BIGINT) AS z FROM (
            SELECT *, CASE WHEN lo = hi THEN 0 ELSE 12 * sqrt(mean * (bad / (good + bad)) * ((good + bad - need) / greatest(1, good + bad - 1))) + 1 END AS wide FROM (
              SELECT *, greatest(0, need - bad) AS lo, least(need, good) AS hi, CASE WHEN good + bad = 0 THEN 0 ELSE need * good / (good + bad) END AS mean FROM (
                SELECT tree.*, side, coalesce(quotas[i], 0) AS good, rest - coalesce(quotas[i], 0) AS bad,
                  CAST('0x' || substr(md5(concat_ws('|', '7', node, i - 1)), 1, 13) AS BIGINT) / 4503599627370496 AS u
                FROM tree, (VALUES (0), (1)) v(side) WHERE shards > 1 AND (side = 0 OR i > len(quotas)))))))))
), leaf AS (SELECT first AS shard, unnest(quotas) AS blocks, unnest(range(1, len(quotas) + 1)) AS nr FROM tree WHERE shards = 1),
ends AS (SELECT shard, nr, sum(blocks) OVER (PARTITION BY nr ORDER BY shard) AS hi, sum(blocks) OVER (PARTITION BY nr ORDER BY shard) - blocks AS lo FROM leaf),
h AS (SELECT doc_id, r.source, size, copy, shard, CAST(sum(got) AS BIGINT) AS words FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source JOIN ends ON ends.nr = n.nr AND rank >= lo AND rank < hi WHERE got > 0 GROUP BY ALL),
g AS (SELECT doc_id, source, size, copy, CAST(sum(words) AS BIGINT) AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards FROM h GROUP BY doc_id, source, size, copy)
SELECT e.doc_id, e.size, e.source_size, e.target, coalesce(g.taken, 0) AS taken, coalesce(g.shards, '') AS shards
FROM e LEFT JOIN g ON e.doc_id IS NOT DISTINCT FROM g.doc_id AND e.source IS NOT DISTINCT FROM g.source AND e.size = g.size AND e.copy = g.copy
"""
