"""Best-fit packing of documents into fixed-length token sequences.

Bounded-space online best-fit. At most ``open_bins`` sequences are open in a task. A bitset
whose bit f says "some open sequence has f free places" finds the tightest fit with one shift
and one lowest-bit test; when nothing fits and all places for open sequences are taken, the
fullest closes. Pieces arrive longest first within an Arrow batch, so short ones fill the gaps.

Every task packs the rows of its own input partition: there is no shuffle, memory does not
depend on the input, and a repeated task gives the same rows.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
#: Parts of words whose ids a worker remembers; a full table keeps those of the texts just read and those met again since it was last full.
CACHED_WORDS = 100_000


class BestFit:
    """Open sequences keyed by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.count, self.made = capacity, open_bins, 0, 0
        self.mask, self.by_free = 0, {}

    def place(self, length: int) -> tuple[int, int]:
        """(sequence number, offset) for a piece of this length."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(number)
            self.mask |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.count -= 1
        return number


class Encoder:
    """Token ids of whole texts.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its
    words' ids in turn. Words of ASCII and Latin-1 letters, where normalising is lower-casing, are
    cut as the tokenizer cuts them, all of a window at a time on their bytes, and only distinct
    parts go to its model; all others go through the whole tokenizer as one part.
    """

    PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    GAP, LETTER, DIGIT, OTHER, ODD = range(5)
    #: Bytes that are cut at a time; a window ends between words, so that only a longer word makes a longer one.
    WINDOW = 1 << 20

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.simple = Tokenizer.from_file(path), most, True
        self._clear()
        printable = [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = np.arange(256, dtype="<u4")  # as the model is given bytes; spaces part what it is given
        self.shown[[b for b in range(256) if b not in printable]] = [256 + k + (k > 31) for k in range(256 - len(printable))]
        kind, lower = np.full(256, self.ODD, np.uint8), np.arange(256, dtype=np.uint8)
        kind[0x21:0x7F] = self.OTHER
        for k, found in ((self.GAP, b" \n"), (self.DIGIT, b"0123456789"), (self.LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\xc3")):
            kind[list(found)] = k
        lower[0x41:0x5B] += 0x20
        self.kind, self.lower = kind.tobytes(), lower.tobytes()
        self.after_kind, self.after_lower = kind, lower  # of the byte after 0xC3
        self.after_kind[0x80:0xC0] = self.LETTER
        self.after_kind[[0x97, 0xB7]] = self.ODD
        self.after_lower[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 0x20
        # the short way is taken only with a tokenizer that it agrees with, on each character among others
        marks = [chr(c) for c in range(0x21, 0x100) if self.PLAIN.fullmatch(chr(c))]
        trial = ["It's", "42%-off:", "Élan", "über", "naïve!!", "x_y", "a1b2", "d'être", "they'll...", *[w for c in marks for w in (c, f"a{c}b", f"7{c}{c}é", f"{c}'s{c}")]]
        trial = [w for w in trial if "<|" not in w]
        want = [np.asarray(ids, "<u4").tobytes() for ids in self._whole(trial)]
        try:
            self.simple = self(trial) == want
        except Exception:  # noqa: BLE001  another kind of model
            self.simple = False
        self._clear()

    def _clear(self) -> None:
        #: Where parts are in the table, the ids of all in turn, how many each has, whether it was met again, and where those just read are.
        self.words, self.table, self.sizes = {}, np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.again, self.last = np.zeros(0, bool), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts in turn, and how many each has."""
        ids, easy, hard, every = [[]] * len(parts), range(len(parts)), [], "".join(parts)
        if not self.simple or "<|" in every or not self.PLAIN.fullmatch(every):
            hard = [k for k, w in enumerate(parts) if not self.simple or "<|" in w or not self.PLAIN.fullmatch(w)]
            easy = sorted(set(easy).difference(hard))
        shown = self.shown[np.frombuffer(" ".join([parts[k] for k in easy]).encode(), np.uint8)].tobytes().decode("utf-32-le").split(" ")
        model = self.tokenizer.model
        for k, w in zip(easy, shown):
            ids[k] = [t.id for t in model.tokenize(w)]
        for i in range(0, len(hard), 4096):
            for k, found in zip(hard[i : i + 4096], self._whole([parts[k] for k in hard[i : i + 4096]]), strict=True):
                ids[k] = found
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes

    def _forget(self, most: int) -> None:
        """Only the parts of the window just read stay, and those met again if they are few enough."""
        keep = self.again if self.again.sum() < most // 2 else np.zeros_like(self.again)
        keep[self.last] = True
        self.words = dict(zip(compress(self.words, keep), range(int(keep.sum())), strict=True))
        self.table, self.sizes = self.table[np.repeat(keep, self.sizes)], self.sizes[keep]
        self.again = np.zeros(len(self.sizes), bool)

    def _known(self, parts: list[str]) -> np.ndarray:
        """Where in the table distinct parts are; new ones are put there."""
        if len(self.words) > (most := self.most or CACHED_WORDS):
            self._forget(most)
        at = np.fromiter(map(self.words.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        at[new] = len(self.words) + np.arange(len(new))
        words = [parts[k] for k in new.tolist()]
        ids, sizes = self._encode(words)
        self.words.update(zip(words, at[new].tolist(), strict=True))
        self.table, self.sizes = np.concatenate([self.table, ids]), np.concatenate([self.sizes, sizes])
        self.again, self.last = np.concatenate([self.again, np.zeros(len(new), bool)]), at
        return at

    def _window(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bytes that end with a gap: the ids, where each part begins, and how many ids each part has."""
        given, data, kind = (np.frombuffer(x, np.uint8) for x in (text, bytearray(text).translate(self.lower), bytearray(text).translate(self.kind)))
        if (lead := np.flatnonzero(given == 0xC3)).size:
            after = given[lead + 1]
            data[lead + 1], kind[lead + 1] = self.after_lower[after], self.after_kind[after]
        gap = kind == self.GAP
        angle = np.flatnonzero(given == 0x3C)
        odd = np.concatenate([np.flatnonzero(kind == self.ODD), angle[given[angle + 1] == 0x7C]]) if self.simple else np.flatnonzero(~gap)
        if odd.size:  # their words stay as they are
            gaps = np.flatnonzero(gap)
            word = np.unique(np.searchsorted(gaps, odd))
            edge = np.zeros(len(given), np.int8)
            edge[np.where(word > 0, gaps[word - 1] + 1, 0)] = 1
            edge[gaps[word]] = -1
            inside = np.cumsum(edge, dtype=np.int8).view(bool)
            data[inside], kind[inside] = given[inside], self.ODD
        new = kind == self.DIGIT
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        new &= ~gap
        quote = np.flatnonzero(data == 0x27)
        quote = quote[new[quote] & (kind[quote] == self.OTHER)]
        if quote.size:  # 's and the like begin where a run of other marks would
            one, two = data[quote + 1], data.take(quote + 2, mode="clip")
            short = np.isin(one, list(b"stmd"))
            long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            new[quote[short | long] + 1] = False
            end = np.concatenate([quote[short] + 2, quote[long] + 3])
            new[end[kind[end] == self.LETTER]] = True
        at = np.flatnonzero(new)
        if not at.size:
            return np.zeros(0, "<u4"), at, at
        data = data[~gap]
        edges = np.append(at - np.cumsum(gap, dtype=np.int32)[at], data.size).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), at.size, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        row = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        count = self.sizes[row]
        first = (np.cumsum(self.sizes) - self.sizes)[row] - (np.cumsum(count) - count)
        return self.table[np.repeat(first, count) + np.arange(count.sum())], at, count

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many there are up to the end of each text."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), *[pa.scalar(x, pa.large_string()) for x in ("", "\n")], null_handling="replace")
        last = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset + 1 :][: len(texts)] - 1  # each text's line feed
        data, at, total, found, ends = joined.buffers()[2].to_pybytes()[: last[-1] + 1], 0, 0, [], []
        while at < len(data):
            end = at + self.WINDOW
            if end < len(data):
                end = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1 or min(k for k in (data.find(b" ", end), data.find(b"\n", end)) if k >= 0) + 1
            some, begins, count = self._window(data[at:end])
            here = last[slice(*np.searchsorted(last, [at, end]))] - at
            ends.append(total + np.append(0, np.cumsum(count))[np.searchsorted(begins, here)])
            found.append(some)
            at, total = end, total + len(some)
        return np.concatenate(found), np.concatenate(ends)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit bytes."""
        ids, ends = self.ids(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, ends)[:-1]]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, seq_len: int = 2048, end_id: int = 0, open_bins: int = 1024, words: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, uint32), sequence_id, offset.

    A null or empty text is the end id alone. Documents longer than ``seq_len`` are cut into full
    pieces and a rest. Repeated rows are packed each; a null doc_id stays null; other columns are
    ignored. An empty table gives no rows. ``words``: how many parts of words a worker remembers, if not CACHED_WORDS.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, bins = Encoder(tokenizer_path, words), BestFit(seq_len, open_bins)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        gc.disable()  # lists of words have no cycles, and there are many
        try:
            for batch in batches:
                ids, ends = encode.ids(batch.column(1))
                ids, ends = np.insert(ids, ends, end_id), ends + 1 + np.arange(len(ends))
                begins = np.append(0, ends)[:-1]
                pieces = -(-(ends - begins) // seq_len)
                doc = np.repeat(np.arange(len(ends)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * seq_len
                length = np.minimum(seq_len, (ends - begins)[doc] - start)
                edges = 4 * np.append(0, np.cumsum(length))
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                order = np.argsort(-length, kind="stable")
                for i in range(0, len(order), 5000):
                    part = order[i : i + 5000]
                    spots = [bins.place(n) for n in length[part].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(doc[part])),
                            pa.array(number[part], pa.int32()),
                            pa.array(start[part], pa.int64()),
                            pa.array(length[part], pa.int64()),
                            data.take(pa.array(part)).cast(pa.binary()),
                            pa.array([first + s for s, _ in spots], pa.int64()),
                            pa.array([o for _, o in spots], pa.int64()),
                        ],
                        names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                    )
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(giving_back(pack), SCHEMA)
