"""Removal of every byte that a 200-byte string covers which also starts elsewhere in the corpus.

A distributed difference-cover suffix sort, carried to the 200 bytes that the question needs:

1. Positions whose residues lie in a difference cover modulo 133 are sampled (12 of 133). Any two
   positions meet the sample at one common distance below 133, so equal 200-byte windows hold equal
   68-byte tuples at equal distances. Sampled tuples are sorted by range and thereby named; a name
   that occurs once tells that no window around it occurs again.
2. Names go one level up with all text that can lie in a window around them, up to 132 bytes before
   the tuple and 200 from its start: where that occurs again too, all its windows do. With so wide a
   cover this level already reaches the whole depth, so the recursion ends here.
3. The remaining suffixes, those that names leave open, are merged: ordered by two hashes of their
   200-byte prefix (96 bits), each once a block, and adjacent ones compared.

The order is that of hashes, as only equality of prefixes is asked for; names with what surrounds
them are told apart by over 100 bits. Texts move once, into a table of blocks bucketed by their
number, so that answers of any size are joined to them without moving texts again. Ranges and buckets
grow in number with the bytes, so none takes more memory in a larger corpus; a hot name comes once a
block and context.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import giving_back, materialise, remove, shared_dir, shuffle_partitions

#: Bytes of text in a block (more where one text is longer), and in the arrays held at a time.
BLOCK, CHUNK = 1_000_000, 250_000
#: Bytes of text in a bucket.
BUCKET = 64_000_000
#: Bytes of text per range of hashes, and the least and most bits that number the ranges.
RANGE_TEXT, RANGE_BITS = 64_000_000, (8, 24)
TWO_BITS = np.array([0, 2, 4, 6], np.uint8)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _tables(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), int(rng.integers(1 << 40, 1 << 62)) * 2 + 1


TABLE, BASE_INT = _tables(20240229)
SECOND_TABLE, SECOND_BASE = _tables(20230131)


def _powers(n: int, root: int = BASE_INT) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(root, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, root), (down, inverse)):
        out[0] = 1
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def difference_cover(size: int) -> tuple[int, list[int]]:
    """(v, residues): any two integers reach the residues modulo v by adding one number below v.

    v = q^2 + q + 1 for the largest listed prime q whose v is at most two thirds of size: the
    zeros of a linear recurrence over q elements are then q + 1 residues with every difference.
    """
    for q in (p for p in (13, 11, 7, 5, 3, 2) if 3 * (p * p + p + 1) <= 2 * size):
        v = q * q + q + 1
        for a, b, c in np.ndindex(q, q, q):
            x = [0, 0, 1]
            while len(x) < v:
                x.append((a * x[-1] + b * x[-2] + c * x[-3]) % q)
            d = [i for i in range(v) if x[i] == 0]
            if len({(i - j) % v for i in d for j in d}) == v and len(d) == q + 1:
                return v, d
    return 1, [0]


class Windows:
    """The windows of a chunk's pieces by hash, and its sampled positions with the windows around each."""

    def __init__(self, chunk: list[tuple[int, int, bytes]], size: int, cover: tuple[int, list[int]], powers: list):
        n = np.array([len(p) for *_, p in chunk], np.int64)
        data = np.frombuffer(b"".join(p for *_, p in chunk), np.uint8)
        total = len(data)
        while not powers or len(powers[0]) < total + 1:
            powers[:] = _powers(max(2 * CHUNK, total + 1))
        up, down = powers
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum(TABLE[data] * up[:total], out=prefix[1:])
        start = np.cumsum(n) - n
        counts = np.maximum(n - size + 1, 0)
        #: where each piece's windows begin
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(start - self.bounds[:-1], counts) + np.arange(counts.sum())
        self.hash = mixed((prefix[at + size] - prefix[at]) * down[at])
        self.data, self.at, self.size = data, at, size

        v, residues = cover
        tuple_ = size - v + 1
        member = np.zeros(v, bool)
        member[residues] = True
        places = np.where(counts > 0, n - tuple_ + 1, 0)
        piece = np.repeat(np.arange(len(n)), places)
        local = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
        sampled = member[(local + np.array([o for _, o, _ in chunk], np.int64)[piece]) % v]
        piece, local = piece[sampled], local[sampled]
        first, last = np.maximum(local - v + 1, 0), np.minimum(local, n[piece] - size)
        #: windows that hold each sampled tuple, last inclusive
        self.first, self.last = self.bounds[piece] + first, self.bounds[piece] + last
        at = start[piece] + local
        self.name = mixed((prefix[at + tuple_] - prefix[at]) * down[at])
        reach = (local - first).astype(np.uint64) << np.uint64(20) | (last - first).astype(np.uint64)
        #: the text of all those windows and the tuple's place in it; the lowest bit is kept free
        self.stretch = mixed(mixed(self.hash[self.first] + reach * ODD) ^ self.hash[self.last]) & ~np.uint64(1)

    def second(self, chosen: np.ndarray, powers: list) -> np.ndarray:
        """32 bits of another hash of the chosen windows."""
        if not chosen.any():
            return np.zeros(0, np.uint32)
        total = len(self.data)
        while not powers or len(powers[0]) < total + 1:
            powers[:] = _powers(max(2 * CHUNK, total + 1), SECOND_BASE)
        up, down = powers
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum(SECOND_TABLE[self.data] * up[:total], out=prefix[1:])
        at = self.at[chosen]
        return (mixed((prefix[at + self.size] - prefix[at]) * down[at]) >> np.uint64(32)).astype(np.uint32)

    def around(self, chosen: np.ndarray) -> np.ndarray:
        """Which windows hold one of the chosen samples."""
        n = len(self.hash)
        return np.cumsum(np.bincount(self.first[chosen], minlength=n + 1)[:n] - np.bincount(self.last[chosen] + 1, minlength=n + 1)[:n]) > 0


def _by_range(ranges: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each of the ascending range numbers begins and ends."""
    found, first = np.unique(ranges, return_index=True)
    return {int(r): (int(lo), int(hi)) for r, lo, hi in zip(found, first, np.append(first, len(ranges))[1:], strict=True)}


class Entries:
    """A block's samples, each pair of name and stretch once, in order of their range."""

    def __init__(self, windows: list[Windows] | Iterator, bits: int):
        both = [(w.name, w.stretch) for _, w in windows]
        name = np.concatenate([n for n, _ in both]) if both else np.zeros(0, np.uint64)
        stretch = np.concatenate([x for _, x in both]) if both else np.zeros(0, np.uint64)
        key = name >> np.uint64(32 - bits)
        # a tie here only leaves an entry twice, which says that it is repeated, as it is
        order = np.argsort((name & np.uint64(0xFFFFFF << 40)) | (mixed(key ^ stretch * ODD) >> np.uint64(24)), kind="stable")
        k, x = key[order], stretch[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
        at = np.flatnonzero(new)
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.name = k[at].astype(np.uint32)
        #: lowest bit: the block has it more than once
        self.stretch = x[at] | (np.diff(at, append=len(k)) > 1).astype(np.uint64)
        self.edge = _by_range(k[at] >> np.uint64(32))

    def codes(self, answers: list[dict] | None) -> np.ndarray:
        codes = np.zeros(len(self.name), np.uint8)
        for a in answers or []:
            lo, hi = self.edge[a["range"]]
            codes[lo:hi] = (np.frombuffer(a["data"], np.uint8)[:, None] >> TWO_BITS & 3).ravel()[: hi - lo]
        return codes[self.of]


def _pieces(texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (text number, offset, bytes); a long text comes in parts that share size - 1 bytes."""
    chunk, held = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - size + 1), CHUNK):
            part = t[at : at + CHUNK + size - 1]
            chunk.append((k, at, part))
            held += len(part)
            if held >= CHUNK:
                yield chunk
                chunk, held = [], 0
    if chunk:
        yield chunk


def _blocks(docs: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, block = [], [], 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        row = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["block", "bytes", "ids", "texts"])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append((t or "").encode())
                held += len(texts[-1])
                if held >= BLOCK:
                    yield row()
                    ids, texts, held, block = [], [], 0, block + 1
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "block long, bytes long, ids array<long>, texts array<binary>")


def _four_a_byte(codes: np.ndarray) -> bytes:
    return np.bitwise_or.reduce(np.pad(codes, (0, -len(codes) % 4)).reshape(-1, 4) << TWO_BITS, axis=1).astype(np.uint8).tobytes()


def _answer1(names: list[np.ndarray], stretches: list[np.ndarray]) -> list[np.ndarray]:
    """By entry, 0: the name occurs once; 1: the run is repeated; 2: it is, and others of its name are open; 3: open."""
    name, stretch = np.concatenate(names), np.concatenate(stretches)
    order = np.lexsort((stretch, name))
    name, stretch = name[order], stretch[order]
    group = np.cumsum(np.concatenate([[True], name[1:] != name[:-1]])) - 1
    again = (stretch & np.uint64(1)).astype(bool)
    stretch = stretch >> np.uint64(1)
    same = (name[1:] == name[:-1]) & (stretch[1:] == stretch[:-1])
    again[1:] |= same
    again[:-1] |= same
    size = np.bincount(group)[group]
    open_ = (np.bincount(group, weights=~again)[group] > 0) & (size > 1)
    code = np.where((size == 1) & ~again, 0, np.where(~open_, 1, np.where(again, 2, 3))).astype(np.uint8)
    out = np.empty_like(code)
    out[order] = code
    return np.split(out, np.cumsum([len(x) for x in names])[:-1])


def _distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (h, c) in order, each once; which of them each row is; how many rows each has."""
    order = np.lexsort((c, h))
    hs, cs = h[order], c[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    group = np.cumsum(new) - 1
    of = np.empty(len(hs), np.int64)
    of[order] = group
    return hs[new], cs[new], of, np.bincount(group, minlength=int(new.sum()))


def _answer2(hashes: list[np.ndarray], seconds: list[np.ndarray]) -> list[np.ndarray]:
    """By entry: whether another block has it."""
    *_, of, count = _distinct(np.concatenate(hashes), np.concatenate(seconds))
    return np.split(count[of] > 1, np.cumsum([len(x) for x in hashes])[:-1])


def _runs(texts: list[bytes], size: int):
    """A function to go over a block's chunks and their windows; those of a usual block are kept."""
    cover = difference_cover(size)

    def fresh() -> Iterator[tuple[list, Windows]]:
        powers: list = []
        for chunk in _pieces(texts, size):
            yield chunk, Windows(chunk, size, cover, powers)

    if sum(map(len, texts)) > 2 * BLOCK:
        return fresh
    kept = list(fresh())
    return lambda: kept


def _open_windows(runs, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, seconds, at, powers = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], 0, []
    for _, w in runs():
        c = codes[at : at + len(w.first)]
        at += len(c)
        chosen = w.around(c >= 2)
        hashes.append(w.hash[chosen])
        seconds.append(w.second(chosen, powers))
    return np.concatenate(hashes), np.concatenate(seconds)


@contextlib.contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What is written here once frees its shuffle files at its end, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _bucketed(blocks: DataFrame, parts: int) -> DataFrame:
    """blocks as a written table of ``parts`` buckets by block, which joins by block without a shuffle."""
    spark = blocks.sparkSession
    name = f"equiflow_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with _freeing(spark):
        blocks.repartition(parts, "block").write.bucketBy(parts, "block").option("path", path).saveAsTable(name)
    atexit.register(_drop, spark, name, path)
    return spark.table(name)


def _drop(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass
    remove(spark, path)


def _with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """blocks with the answers to each: these are shuffled and hashed, the blocks stay in their buckets."""
    by = answers.groupBy("block").agg(F.collect_list(F.struct("range", "data")).alias(name))
    return blocks.join(by.hint("shuffle_hash"), "block", "left")


def _texts(b: pa.RecordBatch, i: int) -> list[bytes]:
    return b.column("texts")[i].as_py()


def remove_repeats(docs: DataFrame, size: int = 200) -> DataFrame:
    """doc_id, n_bytes, spans (start, end in bytes, maximal, of what is removed), kept (the rest).

    Texts are judged as UTF-8 on the whole input; matches never cross documents but may overlap
    and may lie in one document. A null text counts as empty and loses nothing, and neither does
    one of under ``size`` bytes. Repeated rows are copies of each other, so they go wholly if long
    enough. A null doc_id stays null; other columns are ignored; an empty table gives no rows.
    A text may have up to 2 GB, what Arrow can hold in a value.
    """
    with _freeing(docs.sparkSession):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = total // RANGE_TEXT
    blocks = _bucketed(_blocks(docs), max(shuffle_partitions(docs.sparkSession), total // BUCKET))
    bits = min(max(RANGE_BITS[0], wide.bit_length()), RANGE_BITS[1])

    def send1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                e = Entries(_runs(_texts(b, i), size)(), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(e.edge), pa.int32()), pa.array([b.column("block")[i].as_py()] * len(e.edge), pa.int64()), pa.array([e.name[lo:hi].tobytes() for lo, hi in e.edge.values()], pa.binary()), pa.array([e.stretch[lo:hi].tobytes() for lo, hi in e.edge.values()], pa.binary())],
                    names=["range", "block", "names", "stretches"],
                )

    def answer1(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        codes = _answer1([np.frombuffer(x, np.uint32) for x in table.column("names").to_pylist()], [np.frombuffer(x, np.uint64) for x in table.column("stretches").to_pylist()])
        return pa.table({"block": table.column("block"), "range": table.column("range"), "data": pa.array([_four_a_byte(c) for c in codes], pa.binary())})

    def send2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                runs = _runs(_texts(b, i), size)
                hashes, seconds, *_ = _distinct(*_open_windows(runs, Entries(runs(), bits).codes(b.column("codes")[i].as_py())))
                edge = _by_range(hashes >> np.uint64(64 - bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(edge), pa.int32()), pa.array([b.column("block")[i].as_py()] * len(edge), pa.int64()), pa.array([blobs.pack(hashes[lo:hi]) for lo, hi in edge.values()], pa.binary()), pa.array([seconds[lo:hi].tobytes() for lo, hi in edge.values()], pa.binary())],
                    names=["range", "block", "hashes", "seconds"],
                )

    def answer2(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        again = _answer2([blobs.unpack(x) for x in table.column("hashes").to_pylist()], [np.frombuffer(x, np.uint32) for x in table.column("seconds").to_pylist()])
        return pa.table({"block": table.column("block"), "range": table.column("range"), "data": pa.array([np.packbits(a).tobytes() for a in again], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for i in range(b.num_rows):
                texts = _texts(b, i)
                runs = _runs(texts, size)
                codes = Entries(runs(), bits).codes(b.column("codes")[i].as_py())
                asked, _, of, count = _distinct(*_open_windows(runs, codes))
                edge = _by_range(asked >> np.uint64(64 - bits))
                again = count > 1
                for a in b.column("bits")[i].as_py() or []:
                    lo, hi = edge[a["range"]]
                    again[lo:hi] |= np.unpackbits(np.frombuffer(a["data"], np.uint8), count=hi - lo).astype(bool)
                repeated, done = again[of], 0
                gone, at = [np.zeros(len(t) + 1, np.int32) for t in texts], 0
                for chunk, w in runs():
                    c = codes[at : at + len(w.first)]
                    at += len(c)
                    hit = w.around((c == 1) | (c == 2))
                    look = np.flatnonzero(w.around(c >= 2))
                    hit[look] |= repeated[done : done + len(look)]
                    done += len(look)
                    for p, (k, offset, _) in enumerate(chunk):
                        s = np.flatnonzero(hit[w.bounds[p] : w.bounds[p + 1]]) + offset
                        gone[k][s] += 1
                        gone[k][s + size] -= 1
                spans, kept = [], []
                for t, g in zip(texts, gone, strict=True):
                    covered = np.cumsum(g[:-1]) > 0
                    edges = np.flatnonzero(np.diff(covered, prepend=False, append=False)).reshape(-1, 2)
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
                    kept.append(np.frombuffer(t, np.uint8)[~covered].tobytes() if len(edges) else t)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    answer = "block long, range int, data binary"
    with _freeing(docs.sparkSession):
        codes = materialise(blocks.mapInArrow(giving_back(send1), "range int, block long, names binary, stretches binary").groupBy("range").applyInArrow(answer1, answer))
    known = _with_answers(blocks, codes, "codes")
    with _freeing(docs.sparkSession):
        found = materialise(known.mapInArrow(giving_back(send2), "range int, block long, hashes binary, seconds binary").groupBy("range").applyInArrow(answer2, answer))
    return _with_answers(known, found, "bits").mapInArrow(giving_back(finish), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
