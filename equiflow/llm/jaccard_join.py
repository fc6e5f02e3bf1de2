"""Exact similarity join of documents on word shingles, in the metric space of Jaccard distance.

1. Equal shingle sets become one class; only classes are compared. A class is named by 128 bits.
2. A class can have a partner only if at least 80 % of its shingles occur elsewhere. All shingles
   below a fixed hash value are exchanged as packed blobs to count that, which leaves the few
   classes that can have partners.
3. Pivots make cells of those. Two classes that link share one of their rarest 20 % of shingles
   and are of like size; the least class (in the order of a hash) of all that share such a shingle
   and size is a pivot, and a class lies in the cell of every pivot that it has this way. So any two
   that link meet in a cell, and a class near several pivots is replicated to each.
4. Within a cell pivots are chosen until every class lies within the link distance r of one:
   Voronoi cells of radius r, whose members link to their pivot. By the triangle inequality only
   classes within 2r of another cell's pivot can have links across; those boundary classes are
   compared with the members of that cell in the window that the inequality leaves. Cells too large
   for a task are first joined with some pivots over all executors, and what the inequality leaves
   open goes on recursively.

No pairs within a group are listed, nothing is capped, and all tests are on exact counts (of
64-bit shingle hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs
from .common import connected, giving_back, join_hot, materialise, shuffle_partitions

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
CACHED_WORDS = 200_000
BLOCK_TOKENS, BLOCK_DOCS = 1_500_000, 60_000
SHARE = 0.4
#: Rows of two longs that are broadcast; larger tables are shuffled.
SMALL = 1_000_000


class Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], known: Words, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    n = [len(s) for s in split]
    flat = np.fromiter((known[w] for s in split for w in s), np.uint64, sum(n))
    many = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for j in range(size):
        many += flat[j : len(flat) - size + 1 + j] * MIX[j]
    many = mixed(many)
    out, at = [], 0
    for k in n:
        if k >= size:
            s = np.sort(many[at : at + k - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif k:
            out.append(mixed((flat[at : at + k] * MIX[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            out.append(flat[:0])
        at += k
    return out


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _classes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_shingles, class and the long columns ``more``: a row for each of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sets = shingle_sets(part.column(1).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), *part.columns[2:]], names=["doc_id", "n_shingles", "class", *more])

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(giving_back(run), ", ".join(["doc_id long", "n_shingles long", "class binary", *(f"{c} long" for c in more)]))


def _possible(docs: DataFrame, rows: int, ratio: float) -> DataFrame:
    """Classes (one column, maybe repeated) of which enough shingles occur in other documents too."""
    bits = min(56, max(20, (max(1, rows) * 512 - 1).bit_length() + 9))
    ranges = max(shuffle_partitions(docs.sparkSession), int(SHARE * 2**bits) >> 31)
    per = int(SHARE * 2**bits) // ranges + 1
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, seen, at, block = Words(), [], {}, 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24

        def flush():
            names = np.concatenate([h[2] for h in held])
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h[2]) for h in held])
            order = np.argsort(names, kind="stable")
            names, owner = names[order], owner[order]
            edge = np.searchsorted(names, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(per))
            head = np.concatenate([np.frombuffer(b"".join(h[0] for h in held), "<i8").reshape(-1, 2), np.array([(h[1], len(h[2])) for h in held], "<i8")], 1).tobytes()
            keep = [r for r in range(ranges) if edge[r] < edge[r + 1] or r == 0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keep, pa.int32()),
                    pa.array([block] * len(keep), pa.int64()),
                    pa.array([blobs.pack(names[edge[r] : edge[r + 1]] - np.uint64(r * per)) for r in keep], pa.binary()),
                    pa.array([blobs.pack(owner[edge[r] : edge[r + 1]]) for r in keep], pa.binary()),
                    pa.array([head if r == 0 else None for r in keep], pa.binary()),
                ],
                names=["range", "block", "names", "owner", "head"],
            )

        for b in batches:
            for i in range(0, b.num_rows, 1000):
                for s in shingle_sets(b.column(0).slice(i, 1000).to_pylist(), known):
                    if not len(s) or (key := digest(s)) in seen:
                        continue
                    seen[key] = True
                    names = s[s < np.uint64(int(SHARE * 2**64))] >> shift
                    held.append((key, len(s), names))
                    at += len(names)
                    if at >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                        yield flush()
                        held, seen, at, block = [], {}, 0, block + 1
        if held:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = [blobs.unpack(x) for x in table.column("names").to_pylist()]
        owner = [blobs.unpack(x, False) for x in table.column("owner").to_pylist()]
        all_names = np.concatenate(names)
        order = np.argsort(all_names, kind="stable")
        ranked = all_names[order]
        same = np.zeros(len(ranked), bool)
        if len(ranked) > 1:
            eq = ranked[1:] == ranked[:-1]
            same[1:] |= eq
            same[:-1] |= eq
        again = np.empty(len(ranked), bool)
        again[order] = same
        out, at = [], 0
        for o in owner:
            hit = o[again[at : at + len(o)]]
            out.append(np.bincount(hit).astype("<u4").tobytes())
            at += len(o)
        return pa.table({"block": table.column("block"), "counts": pa.array(out, pa.binary()), "head": table.column("head")})

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        head = next(np.frombuffer(h, "<i8").reshape(-1, 4) for h in table.column("head").to_pylist() if h)
        total = np.zeros(len(head), np.int64)
        for c in table.column("counts").to_pylist():
            c = np.frombuffer(c, "<u4")
            total[: len(c)] += c
        # of n shingles at most (1 - ratio) * n may be missing in a partner
        missing = np.floor((1 - ratio) * head[:, 2] + 1e-9)
        return pa.table({"class": pa.array([k.tobytes() for k in head[total >= head[:, 3] - missing, :2]], pa.binary())})

    sent = docs.select("text").mapInArrow(giving_back(send), "range int, block long, names binary, owner binary, head binary")
    counts = sent.groupBy("range").applyInArrow(count, "block long, counts binary, head binary")
    return counts.groupBy("block").applyInArrow(judge, "class binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class (the number in wanted), n, set of the wanted (key, rep, class) documents.

    They are found by a scan with a bitmap of 32 bits a wanted class, 64 MB at most. It may let others
    through, the more the fewer bits a class has; the join with wanted drops those. A copy of a wanted
    class that comes through does no harm.
    """
    many = wanted.count()
    bits = max(16, min(29, (32 * many - 1).bit_length()))
    place = F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long").bitwiseXOR(F.coalesce("rep", F.lit(-1))).bitwiseAND(F.lit((1 << bits) - 1))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("w"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()  # at most 2^23 rows
    bitmap[got.column("at").to_numpy()] = got.column("w").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sets = shingle_sets(part.column(1).to_pylist(), known)
                keys = [digest(s) for s in sets]
                first = (np.frombuffer(b"".join(k[:8] for k in keys), ">u8") >> np.uint64(8)).astype(np.int64)
                p = (first ^ part.column(0).fill_null(-1).to_numpy()) & ((1 << bits) - 1)
                found = np.flatnonzero((held.value[p >> 6] >> (p & 63)) & 1)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in found], pa.binary()), pa.array([len(sets[i]) for i in found], pa.int64()), pa.array([sets[i].view(np.int64) for i in found], pa.list_(pa.int64()))], names=["key", "n", "set"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), "key binary, n long, set array<long>")
    return found.join(_small(wanted.select("key", "class"), many), "key").select("class", "n", "set")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df for a broadcast if it has few (thin) rows, else as it is, for a join by shuffle."""
    return F.broadcast(df) if rows <= SMALL else df


def links(n: np.ndarray, common: np.ndarray, size: int, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + size - common)


def join_region(keys: np.ndarray, sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """Edges that connect what links connect, among the sets of one region."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def common(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
        k = hi - lo
        at = np.repeat(hi - np.cumsum(k), k) + np.arange(k.sum())
        return np.bincount(owner[at], minlength=len(sets))

    r = 1 - percent / 100
    free, boundary = np.ones(len(sets), bool), {}
    for p in range(len(sets)):
        if not free[p]:
            continue
        c = common(p)
        near = links(n, c, n[p], percent)
        for i in np.flatnonzero(near):
            root[find(i)] = find(p)
        free &= ~near
        for i in np.flatnonzero(~near & (1 - c / (n + n[p] - c) <= 2 * r + 1e-9)):
            boundary.setdefault(int(i), []).append(p)
    for i, pivots in boundary.items():
        if any(find(p) != find(i) for p in pivots):
            for j in np.flatnonzero(links(n, common(i), n[i], percent)):
                root[find(j)] = find(i)
    return [(int(keys[i]), int(keys[find(i)])) for i in range(len(sets)) if find(i) != i]


def _sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.sum("n").alias("tokens"))


def _pivot_round(cells: DataFrame, sizes: DataFrame, pivots: int, percent: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One level over large cells (cell, class, n, set): (edges found, what is still open).

    A cell is dealt to as many tasks as it has ``limit`` shingles, and ``pivots`` of its sets go to
    each; a class learns its distance to them there. sizes: cell, tokens.
    """
    r = 1 - percent / 100
    few = Window.partitionBy("cell").orderBy("h", "class")  # Spark keeps the first of each task before the shuffle
    heads = materialise(cells.select("cell", "class", F.xxhash64("class", F.lit(pivots)).alias("h")).withColumn("k", F.row_number().over(few)).filter(F.col("k") <= pivots).select("cell", "class"))
    parts = F.ceil(F.col("tokens") / limit).cast("int")
    dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int")).withColumn("pivot", F.lit(False))
    sent = cells.join(heads, ["cell", "class"], "left_semi").join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("pivot", F.lit(True))
    columns = ["cell", "part", "class", "pivot", "set"]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, is_pivot = table.column("class").to_numpy(), table.column("pivot").to_numpy()
        column = table.column("set").combine_chunks()
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        set_of = lambda i: values[ends[i] : ends[i + 1]]
        out = []
        mine = np.flatnonzero(~is_pivot)
        owner = np.repeat(np.arange(len(mine)), [ends[i + 1] - ends[i] for i in mine])
        flat = np.concatenate([set_of(i) for i in mine]) if len(mine) else values[:0]
        n = np.bincount(owner, minlength=len(mine))
        for i in np.flatnonzero(is_pivot):
            t = set_of(i)
            at = np.minimum(np.searchsorted(t, flat), len(t) - 1)
            c = np.bincount(owner[t[at] == flat], minlength=len(mine))
            d = 1 - c / (n + len(t) - c)
            for j in np.flatnonzero(d <= 2 * r + 1e-9):
                out.append((ids[mine[j]], ids[i], d[j], bool(links(n[j], c[j], len(t), percent))))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({"cell": pa.array([key[0].as_py()] * len(out), pa.int64()), **{k: pa.array(c, t) for k, c, t in zip(("class", "pivot", "d", "near"), cols, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)}})

    both = dealt.select(*columns).unionByName(sent.select(*columns))
    dist = materialise(both.groupBy("cell", "part").applyInArrow(run, "cell long, class long, pivot long, d double, near boolean"))
    near = dist.filter("near")
    edges = near.filter("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    home = near.groupBy("cell", "class").agg(F.min(F.struct("d", "pivot")).alias("home")).select("cell", "class", F.col("home.d").alias("d0"), F.col("home.pivot").alias("p0"))
    # open: classes without a home, and those near another pivot that isn't connected to theirs
    names = heads.select(F.col("class").alias("pivot")).distinct()
    if not edges.isEmpty():
        names = names.join(connected(edges).withColumnRenamed("node", "pivot"), "pivot", "left").select("pivot", F.coalesce("root", "pivot").alias("group"))
    else:
        names = names.withColumn("group", F.col("pivot"))
    names = materialise(names)
    placed = dist.join(home, ["cell", "class"], "left").join(names, "pivot").join(names.selectExpr("pivot AS p0", "group AS g0"), "p0", "left")
    needy = placed.filter("g0 IS NULL OR group <> g0").select("cell", "class", "pivot", "d")
    window = needy.groupBy("cell", "pivot").agg(F.min("d").alias("m"))
    members = home.join(window.select("cell", F.col("pivot").alias("p0"), "m"), ["cell", "p0"]).filter(F.col("d0") >= F.col("m") - r - 1e-9).select("cell", "class")
    ids = cells.select("cell", "class").join(home, ["cell", "class"], "left_anti").unionByName(needy.select("cell", "class")).unionByName(members).distinct().join(heads, ["cell", "class"], "left_anti")
    return edges, materialise(cells.join(ids, ["cell", "class"], "left_semi").select("cell", "class", "n", "set"))


def class_links(sets: DataFrame, *, percent: int = 80, cell_tokens: int = 1_000_000, pivots: int = 16) -> DataFrame:
    """Edges (a, b) between classes that connect exactly what links connect. sets: class, n, set."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    # tokens in more than this many classes are frequent; there are at most 2^20 of them
    often = max(16, total >> 20)
    counted = sets.select(F.explode("set").alias("token")).groupBy("token").count().filter(F.col("count") > often).toArrow()
    tokens = counted.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    held = sets.sparkSession.sparkContext.broadcast((tokens[order], np.log2(counted.column("count").to_numpy()[order]).astype(np.int8) if len(order) else np.zeros(0, np.int8)))
    width = -np.log(percent / 100) * 1.0001  # two sizes of just that ratio stay neighbours

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, how = held.value
        for b in batches:
            keys, out = [], []
            for k, s in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                s = s.values.to_numpy().view(np.uint64)
                n = len(s)
                f = np.zeros(n, np.int8)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    f = np.where(frequent[at] == s, how[at], 0)
                first = s[np.lexsort((s, f))[: n - -(-percent * n // 100) + 1]]
                # sizes of partners are in the same or a neighbouring range, so each class joins two
                size = int(np.log(n) / width)
                for g in (size, size + 1):
                    out.append(mixed(first + np.uint64(int(MIX[0]) * g % (1 << 64))).view(np.int64))
                    keys.append(np.full(len(first), k, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out, keys)], names=["token", "class"])

    rare = materialise(sets.select("class", "n", "set").mapInArrow(giving_back(rarest), "token long, class long"))
    first = rare.groupBy("token").agg(F.min(F.struct(F.xxhash64("class"), "class")).alias("first"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("first.class").alias("cell"))
    members = materialise(rare.join(first, "token").select("cell", "class").distinct())
    # a cell holds its pivot; one that is all its members have of a cell is no cell
    members = materialise(members.filter("cell <> class").unionByName(members.filter("cell <> class").select("cell", F.col("cell").alias("class")).distinct()))
    cells = sets.join(_small(members, members.count()), "class").select("cell", "class", "n", "set")
    sizes = materialise(_sums(cells))
    edges = None
    big = sizes.filter(F.col("tokens") > cell_tokens)
    if not big.isEmpty():
        few = _small(big, total // cell_tokens)
        left = materialise(cells.join(few.select("cell"), "cell"))
        cells = cells.join(few.select("cell"), "cell", "left_anti")
        while True:
            found, left = _pivot_round(left, big, pivots, percent, cell_tokens)
            edges = found if edges is None else edges.unionByName(found)
            sizes = materialise(_sums(left))
            big = sizes.filter(F.col("tokens") > cell_tokens)
            cells = cells.unionByName(left.join(big, "cell", "left_anti"))
            if big.isEmpty():
                break
            left, pivots = materialise(left.join(big.select("cell"), "cell")), pivots * 2

    def local(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = table.column("set").combine_chunks()
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        keys = table.column("class").to_numpy()
        _, first = np.unique(keys, return_index=True)
        found = join_region(keys[first], [values[ends[i] : ends[i + 1]] for i in first], percent)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    inside = cells.groupBy("cell").applyInArrow(local, "a long, b long")
    return inside if edges is None else edges.unionByName(inside)


def _grouped(docs: DataFrame, percent: int, *more: str, **options) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(own: doc_id, n_shingles, class and ``more`` of every row; groups: class, rep, copies; linked: class, rep, root; rows).

    rep is the smallest doc_id of a class. linked holds the classes that have links, root names their
    component. With ``more`` groups and linked have first, too: (none, doc_id, more) of the row that
    leads the class, a null doc_id only if no other is there.
    """
    rows = docs.count()
    own = materialise(_classes(docs, *more))
    leads = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *more)).alias("first")] if more else []
    groups = materialise(own.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *leads))
    possible = _possible(docs, rows, percent / 100).distinct().join(groups, "class").withColumnRenamed("class", "key")
    wanted = materialise(possible.drop("copies").withColumn("class", F.monotonically_increasing_id()))
    linked = wanted.withColumn("root", F.lit(None).cast("long"))
    if not wanted.isEmpty():
        roots = connected(class_links(materialise(_sets(docs, wanted)), percent=percent, **options))
        linked = wanted.join(roots.withColumnRenamed("node", "class"), "class")
    return own, groups, linked.drop("class").withColumnRenamed("key", "class"), rows


def near_duplicates(docs: DataFrame, *, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a set is the distinct
    5-word shingles, the whole sequence with fewer words. Null, empty and blank texts have empty
    sets and are linked with nothing. component_id is the smallest doc_id reachable over links
    (Jaccard >= percent / 100), null if none in reach has one. Repeated rows are in one component;
    other columns are ignored. An empty table gives no rows.
    """
    own, groups, linked, rows = _grouped(docs, percent, **options)
    lowest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = materialise(linked.join(lowest, "root").select("class", F.struct("component_id").alias("low")))
    groups = materialise(groups.join(known, "class", "left").select("class", "copies", F.when(F.col("low").isNull(), F.col("rep")).otherwise(F.col("low.component_id")).alias("component_id")))
    alone = own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = join_hot(own.filter("n_shingles > 0"), groups, "class", "copies", rows)
    return found.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def drop_near_copies(docs: DataFrame, *, percent: int = 80, **options) -> DataFrame:
    """The rows of docs, all columns: one of each component, and all that have no shingles.

    The row with the smallest doc_id leads its component, one with a null doc_id only if no other is
    there; of rows that share that doc_id the one with the least hash of all columns. Rows are told
    apart by that 64-bit hash and their doc_id, so rows with one doc_id in different components all
    stay. Null and empty texts have no shingles; an empty table gives no rows.
    """
    columns = docs.columns
    row = F.xxhash64(*[c for name in columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))])  # nulls alone don't change a hash
    _, groups, linked, _ = _grouped(docs.select("doc_id", "text", row.alias("row")), percent, "row", **options)
    leads = linked.groupBy("root").agg(F.min("first").alias("first")).select("first").unionByName(groups.join(linked, "class", "left_anti").select("first"))
    leads = leads.select(F.col("first.row").alias("row"), F.col("first.doc_id").alias("lead"))
    full = docs.select(F.struct(*columns).alias("all"), F.col("doc_id").cast("long").alias("id"), row.alias("row"))
    empty = F.trim(F.regexp_replace(F.coalesce(F.col("all.text"), F.lit("")), r"[\x20\x09-\x0D]+", "")) == ""
    w = Window.partitionBy("row").orderBy("id")  # equal rows
    kept = full.filter(~empty).join(leads, "row").filter(F.col("id").eqNullSafe(F.col("lead"))).withColumn("k", F.row_number().over(w)).filter("k = 1")
    return full.filter(empty).select("all.*").unionByName(kept.select("all.*"))
