"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for what they don't cover.

A candidate is a run of key-like characters in a text that holds a sensitive word, before or after it
or as a name joined to it by ``=``, ``_`` or ``-``. It has letters and digits, or letters alone that
make no words. It is compressed with the text around it, less its own repetitions, the identifiers of
the whole text and a list of common ones as dictionary; the bytes it adds tell how much of it the
dictionary explains. Names and prose cost little, random keys cost all they hold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_ -]?key|credential|private|auth|bearer|signature|client[_ -]?id|access[_ -]?key", re.ASCII | re.IGNORECASE)
# a name before the value in the same run, as in client_secret-...; what is left must be a candidate itself
NAME = re.compile(rf"(?:[A-Za-z]+[_-])*?(?:{SENSITIVE.pattern})(?:[_-]?(?:key|id|token|value))*[_-]+", re.ASCII | re.IGNORECASE)
IDENTIFIERS = " ".join(
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret credential authorization "
    "bearer session signature encrypt decrypt username user_id account config settings environment variable function return class "
    "import export default string integer boolean request response header content_type application json http https localhost example "
    "index value object array length buffer stream encode decode base64 sha256 md5 version release commit branch origin master".split()
).encode()
IDENTIFIER = re.compile(r"[A-Za-z_]{3,}")
AROUND = 256
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,novelty:double>>"


def surroundings(text: str, start: int, end: int) -> str:
    """What stands around text[start:end] without repetitions of it, whole ones or cut by the window."""
    value, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    for k in range(min(len(value) - 1, AROUND), 3, -1):
        if before.startswith(value[-k:]):
            before = before[k:]
            break
    for k in range(min(len(value) - 1, AROUND), 3, -1):
        if after.endswith(value[:k]):
            after = after[:-k]
            break
    return before.replace(value, "") + after.replace(value, "")


def key_like(run: str) -> bool:
    """Letters and digits; or, of letters alone, few vowels or case that changes as in no name."""
    letters = [c for c in run if c.isalpha()]
    if any(c.isdigit() for c in run):
        return bool(letters)
    turns = sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False))
    return 5 * sum(c in "aeiouyAEIOUY" for c in letters) < len(letters) or (len(run) >= 20 and 6 * turns >= len(run))


def identifiers(text: str) -> set[str]:
    return set(IDENTIFIER.findall(text))


def novelty(text: str, start: int, end: int, names: set[str] | None = None) -> float:
    """Marginal compressed bytes per byte of text[start:end], given its surroundings and the identifiers.

    names: the text's identifiers; those that are a part of the run itself explain nothing.
    """
    run = text[start:end]
    own = " ".join(sorted(w for w in (identifiers(text) if names is None else names) if w not in run)).encode()
    around = surroundings(text, start, end).encode()
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + own + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    zip_ = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = text[start:end].encode()
    return max(0, len(zip_.compress(data)) - len(zip_.compress(b""))) / max(1, len(data))


def find_secrets(text: str, least_novelty: float = 0.7) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, novelty) by start, then kind; offsets in code points, end exclusive.

    Base spans always stay; ``novel`` spans never overlap them.
    """
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[group]) >= least)
    starts, ends = [s for s, *_ in found], list(accumulate((e for *_, e in found), max, initial=0))
    if SENSITIVE.search(text):
        names = identifiers(text)
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            name = NAME.match(text, start, end)
            if name and (rest := CANDIDATE.match(text[name.end() : end])):
                start, end = name.end(), name.end() + rest.end()
            # of the base spans that start before its end, none may end behind its start
            if key_like(text[start:end]) and ends[bisect_left(starts, end)] <= start and (new := novelty(text, start, end, names)) >= least_novelty:
                found.append((start, len(BASE), "novel", end, new))
    return [(kind, s, e, round(n[0] if n else novelty(text, s, e, set()), 4)) for s, _, kind, e, *n in sorted(found)]


def scan_secrets(docs: DataFrame, least_novelty: float = 0.7) -> DataFrame:
    """doc_id and spans (kind, start, end, novelty) of every row; no shuffle.

    A null text counts as empty and has no spans; repeated rows are scanned each; a null doc_id
    stays null; other columns are ignored; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "novelty"), x, strict=True)) for x in find_secrets(t or "", least_novelty)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)
