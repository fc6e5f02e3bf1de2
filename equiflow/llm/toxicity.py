"""Toxicity scores from a small bidirectional gated recurrent network, trained and run in numpy.

A text is read as overlapping windows of words, all of them. A word enters as its own learned
vector (starting from how much oftener toxic training texts hold it) plus the mean of its
character trigrams' vectors, so unknown spellings still say something. Both directions of a gated
recurrent unit read a window, attention pools its states, and a text's score is that of its worst
window.

Only a bounded sample of labelled rows reaches the driver (``per_class`` of each label, picked by
a hash of doc_id, and of the clean ones ``clean_windows`` windows); the fitted network is some hundred kB and is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import give_back, giving_back

WORD = re.compile(r"[^\W\d_]+")
WINDOW, STEP = 24, 12
WORD_DIM, CHAR_DIM, HIDDEN, TRIGRAMS = 6, 6, 8, 2048
#: Tables with a row a word or trigram learn slowly, or a small sample would be learnt by heart.
SLOW = ("emb", "tri")
#: Distinct words whose inputs a worker remembers, and windows it reads at a time.
CACHED_WORDS, BATCH = 100_000, 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def windows(n: int) -> list[int]:
    """Starts of the windows over n words: each word is in one at least, most are in two."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]


def trigrams(word: str) -> np.ndarray:
    w = f"<{word}>"
    return np.array([zlib.crc32(w[i : i + 3].encode()) % TRIGRAMS for i in range(max(1, len(w) - 2))], np.uint16)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gates(x: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool) -> tuple[np.ndarray, list]:
    """x (T, B, 3H) holds the inputs' share of update, reset and new state; returns states and what the gradient needs."""
    t, b, _ = x.shape
    h, states, kept = np.zeros((b, HIDDEN), np.float32), np.empty((t, b, HIDDEN), np.float32), []
    for i in reversed(range(t)) if backward else range(t):
        hu = h @ u
        zr = sigmoid(x[i, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[i, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        m = mask[i][:, None]
        kept.append((i, h, hu, z, r, new, m))
        h = h + m * (1 - z) * (new - h)
        states[i] = h
    return states, kept


def gates_back(d_states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, du, dh = np.zeros((*d_states.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), 0.0
    for i, h, hu, z, r, new, m in reversed(kept):
        dh = dh + d_states[i]
        d_new = dh * m * (1 - z) * (1 - new * new)
        dz = -dh * m * (new - h) * z * (1 - z)
        dr = d_new * hu[:, 2 * HIDDEN :] * r * (1 - r)
        d_hu = np.concatenate([dz, dr, d_new * r], 1)
        dx[i] = np.concatenate([dz, dr, d_new], 1)
        du += h.T @ d_hu
        dh = dh * (1 - m * (1 - z)) + d_hu @ u.T
    return dx, du


class Network:
    """Parameters in a dict of float32 arrays, so they can be pickled and stepped as one."""

    def __init__(self, words: dict[str, int], start: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.words = words
        emb = 0.1 * rng.standard_normal((len(words) + 1, WORD_DIM)).astype(np.float32)
        emb[1:, 0], emb[0] = start, 0
        self.p = {"emb": emb, "tri": 0.05 * rng.standard_normal((TRIGRAMS, CHAR_DIM)).astype(np.float32), "att": init(2 * HIDDEN, 2 * HIDDEN), "ask": init(2 * HIDDEN), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32), "b0": np.zeros(3 * HIDDEN, np.float32), "b1": np.zeros(3 * HIDDEN, np.float32)}
        for d in "01":
            self.p["w" + d], self.p["u" + d] = init(WORD_DIM + CHAR_DIM, 3 * HIDDEN), init(HIDDEN, 3 * HIDDEN)
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str], known: dict[str, np.ndarray] | None = None) -> np.ndarray:
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        grams = [known[w] if known else trigrams(w) for w in words]
        n = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = self.p["tri"][np.concatenate(grams)] if grams else np.zeros((0, CHAR_DIM), np.float32)
        chars = np.add.reduceat(flat, np.cumsum(n) - n) / n[:, None] if grams else flat
        return np.concatenate([self.p["emb"][ids], chars.astype(np.float32)], 1)

    def pool(self, s: np.ndarray, mask: np.ndarray) -> tuple:
        a = np.tanh(s @ self.p["att"])
        e = np.where(mask > 0, a @ self.p["ask"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        c = (w[:, :, None] * s).sum(0)
        return a, w, c, c @ self.p["out"] + self.p["bias"]

    def logits(self, x0: np.ndarray, x1: np.ndarray, mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([gates(x0, mask, self.p["u0"], False)[0], gates(x1, mask, self.p["u1"], True)[0]], 2)
        return self.pool(s, mask)[3]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """x (T, B, D): word inputs. The gradient of the mean log loss for all but emb and tri, and that for x."""
        p, g = self.p, {}
        runs = [gates(x @ p["w" + d] + p["b" + d], mask, p["u" + d], d == "1") for d in "01"]
        s = np.concatenate([runs[0][0], runs[1][0]], 2)
        a, w, c, logit = self.pool(s, mask)
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = c.T @ dl, dl.sum(keepdims=True)
        dc = dl[:, None] * p["out"]
        dw = (s * dc).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["ask"] = np.einsum("tbk,tb->k", a, de)
        da = de[:, :, None] * p["ask"] * (1 - a * a)
        g["att"] = np.einsum("tbj,tbk->jk", s, da)
        ds = w[:, :, None] * dc + da @ p["att"].T
        dx = 0.0
        for k, d in enumerate("01"):
            dg, g["u" + d] = gates_back(ds[:, :, k * HIDDEN : (k + 1) * HIDDEN], runs[k][1], p["u" + d])
            g["w" + d], g["b" + d] = np.einsum("tbj,tbk->jk", x, dg), dg.sum((0, 1))
            dx = dx + dg @ p["w" + d].T
        return g, dx


class Scorer:
    """Scores texts in batches; the inputs' share of the gates is kept per distinct word."""

    def __init__(self, net: Network):
        self.net, self.at, self.rows = net, {}, []

    def learn(self, texts: list[list[str]]) -> None:
        new = list({w for words in texts for w in words if w not in self.at})
        if len(self.at) + len(new) > CACHED_WORDS:
            self.at, self.rows = {}, []
            new = list({w for words in texts for w in words})
        if not self.rows:
            self.rows, self.at = [np.zeros((1, 6 * HIDDEN), np.float32)], {"": 0}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            x, p = self.net.inputs(part), self.net.p
            self.rows.append(np.concatenate([x @ p["w0"] + p["b0"], x @ p["w1"] + p["b1"]], 1).astype(np.float32))
            self.at.update(zip(part, range(len(self.at), len(self.at) + len(part)), strict=True))
        self.rows = [np.concatenate(self.rows)] if len(self.rows) > 1 else self.rows

    def worst(self, texts: list[list[str]]) -> np.ndarray:
        """The highest window logit of each text; a text without words has that of an empty window."""
        self.learn(texts)
        at, table = self.at, self.rows[0]
        ids = [np.fromiter(map(at.__getitem__, t), np.int32, len(t)) for t in texts]
        owner, start = [], []
        for k, t in enumerate(texts):
            s = windows(len(t))
            owner += [k] * len(s)
            start += s
        owner, start = np.asarray(owner), np.asarray(start)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int32)])
        first = (np.cumsum(n) - n)[owner] + start
        left = np.minimum(n[owner] - start, WINDOW)
        out = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(owner), BATCH):
            w = flat[first[i : i + BATCH, None] + np.arange(WINDOW)].T
            mask = (np.arange(WINDOW)[:, None] < left[i : i + BATCH]).astype(np.float32)
            x = table[w]
            np.maximum.at(out, owner[i : i + BATCH], self.net.logits(x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        net, out = self.net, []
        for i in range(0, len(texts), 256):
            out.append(self.worst([words_of(t) for t in texts[i : i + 256]]))
        return sigmoid((np.concatenate(out).astype(float) - net.shift) * net.scale) if out else np.zeros(0)


def train(texts: list[str | None], labels: list[int], *, clean_windows: int = 40_000, steps: int = 240, seed: int = 5) -> Network:
    """Fit on labelled texts. Windows of clean texts are clean; of a toxic text, the worst one is toxic.

    Which one that is comes first from the words' log odds, then from the network itself. A step takes
    192 windows of clean texts, drawn from ``clean_windows`` of them picked at random. With one label only (or none) the network gives that label to every text.
    """
    same: dict[str, str] = {}  # a string a distinct word, not one a word
    docs = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]
    y = np.asarray(labels, int)
    pos, neg = [d for d, v in zip(docs, y, strict=True) if v and d], [d for d, v in zip(docs, y, strict=True) if not v and d]
    if not pos or not neg:
        net = Network({}, np.zeros(0, np.float32), seed)
        net.scale, net.shift = 0.0, 0.0
        net.scale, net.shift = (1e-6, -1e7 if y.sum() * 2 > len(y) else 1e7)
        return net
    count = [{}, {}]
    for d, v in zip(docs, y, strict=True):
        for w in set(d):
            count[v][w] = count[v].get(w, 0) + 1
    even = len(pos) / len(neg)
    known = sorted(w for w in {*count[0], *count[1]} if count[0].get(w, 0) + count[1].get(w, 0) >= 4)
    odds = np.asarray([np.log((count[1].get(w, 0) + 3) / (count[0].get(w, 0) * even + 3)) for w in known], np.float32)
    words = {w: i + 1 for i, w in enumerate(known)}
    net = Network(words, np.clip(odds, -3, 3), seed)
    rng = np.random.default_rng(seed)
    value = {w: float(odds[i - 1]) for w, i in words.items()}
    cut = lambda d, s: d[s : s + WINDOW]
    all_pos = [(k, s) for k, d in enumerate(pos) for s in windows(len(d))]
    clean = [(k, s) for k, d in enumerate(neg) for s in windows(len(d))]
    clean = [clean[i] for i in rng.permutation(len(clean))[:clean_windows]]
    best = {}
    for k, s in all_pos:
        v = max(value.get(w, 0.0) for w in cut(pos[k], s))
        best[k] = max(best.get(k, (-9.0, 0)), (v, s))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    grams: dict[str, np.ndarray] = {}
    for step in range(1, steps + 1):
        if step == steps // 2:
            scorer, best = Scorer(net), {}
            for k, d in enumerate(pos):
                s = windows(len(d))
                v = scorer.worst([cut(d, a) for a in s])
                best[k] = (float(v.max()), s[int(v.argmax())])
            del scorer  # its table of words
        chosen = [(pos[k], best[k][1], 1) for k in rng.integers(0, len(pos), 64)] + [(neg[clean[i][0]], clean[i][1], 0) for i in rng.integers(0, len(clean), 192)]
        batch = [cut(d, s) for d, s, _ in chosen]
        target = np.asarray([v for *_, v in chosen], np.float32)
        distinct = list({w for b in batch for w in b})
        spot = {w: i for i, w in enumerate(distinct)}
        for w in distinct:
            if w not in grams:
                grams[w] = trigrams(w)
        e = net.inputs(distinct, grams)
        ids, mask = np.zeros((WINDOW, len(batch)), int), np.zeros((WINDOW, len(batch)), np.float32)
        for j, b in enumerate(batch):
            ids[: len(b), j] = [spot[w] for w in b]
            mask[: len(b), j] = 1
        g, dx = net.gradient(e[ids], mask, target)
        per = np.zeros_like(e)
        np.add.at(per, ids.ravel(), (dx * mask[:, :, None]).reshape(-1, e.shape[1]))
        g["emb"], g["tri"] = np.zeros_like(net.p["emb"]), np.zeros_like(net.p["tri"])
        own = np.fromiter((words.get(w, 0) for w in distinct), np.int64, len(distinct))
        g["emb"][own[own > 0]] = per[own > 0, :WORD_DIM]
        n = np.fromiter((len(grams[w]) for w in distinct), np.int64, len(distinct))
        t = np.concatenate([grams[w] for w in distinct])
        np.add.at(g["tri"], t, np.repeat(per[:, WORD_DIM:] / n[:, None], n, axis=0))
        for k, v in g.items():
            a, b = moments[k]
            a += 0.1 * (v - a)
            b += 0.001 * (v * v - b)
            net.p[k] -= (0.001 if k in SLOW else 0.01) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    top = Scorer(net).worst(docs)
    order = np.argsort(top)
    t, v = top[order].astype(float), y[order]
    wrong = np.concatenate([[0], np.cumsum(v)]) + np.concatenate([np.cumsum((1 - v)[::-1])[::-1], [0]])
    ends = np.concatenate([[t[0] - 2], (t[1:] + t[:-1]) / 2, [t[-1] + 2]])
    tied = np.flatnonzero(wrong == wrong.min())
    widest = max(tied, key=lambda i: (t[i] - t[i - 1]) if 0 < i < len(t) else 0)
    net.shift = float(ends[widest])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, *, per_class: int = 1200, clean_windows: int = 40_000) -> Network:
    """Train on at most ``per_class`` rows of each label that are not held out, and ``clean_windows`` windows of clean ones."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("y")).filter(~held_out(F.col("id")))
    picked = [r for v in (0, 1) for r in rows.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    if not picked:
        return train([], [])
    few = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in picked], "id long, y int"))  # 2 * per_class rows
    got = sorted((r["id"], r["y"], r["text"] or "") for r in docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("id")).select("id", "y", "text").collect())
    net = train([t for *_, t in got], [v for _, v, _ in got], clean_windows=clean_windows)
    give_back()  # the driver keeps no more of the training than the network
    return net


def scored(docs: DataFrame, net: Network, name: str = "score") -> Column:
    """A column of scores over docs.text; a null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(vars(net))

    def batches(texts: Iterator) -> Iterator:
        fitted = Network.__new__(Network)
        vars(fitted).update(held.value)
        scorer = Scorer(fitted)
        for t in texts:
            yield pd.Series(scorer.scores(t.tolist()))

    run = giving_back(batches)

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(texts)

    return score(F.col("text")).alias(name)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the texts don't move.

    Null and empty texts get the score of an empty window; repeated rows are scored each; a null
    doc_id is not held out; other columns are ignored. Without labels of both kinds all texts get
    the label that is there (clean if none). An empty table gives no rows. options: those of ``fit_on``.
    """
    net = fit_on(docs, labels, **options)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), scored(docs, net))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5.

    Null and empty texts have the score of an empty window; rows with null or repeated ids are judged
    each by their text; an empty table gives no rows. options: those of ``fit_on``.
    """
    columns = docs.columns
    net = fit_on(docs, labels, **options)
    return docs.select(F.struct(*columns).alias("all"), scored(docs, net, "how")).filter("how < 0.5").select("all.*")
