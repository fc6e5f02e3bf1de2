"""The corpus operators against brute force, round trips and edge cases."""

import cProfile
import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from equiflow.llm import exact_dedup, html, jaccard_join, mixing, packing, repeats, secrets, spotsigs, toxicity, urls  # noqa: E402
from equiflow.llm import blobs, common  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, n long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def corpus(n=60, seed=3):
    """Small texts with copies, near copies, shared passages, repeated lines, nulls and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("the and of in er on Éa ß x1".split()) for _ in range(rng.randint(1, 3)))
    say = lambda k: " ".join(word() for _ in range(k))
    shared, rows = say(70), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        elif kind == 3:
            text = say(30) + "\n" + shared + " " + say(20)
        elif kind == 4:
            text = (say(6) + "!! ") * rng.randint(1, 30)
        else:
            text = say(rng.randint(0, 150))
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "  one "), (None, "lost"), (1003, "one"), (1005, say(4000))]
    return [(i, t, None, f"s{k % 4}" if k % 7 else None, None, "x", 1) for k, (i, t) in enumerate(rows)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_keeps_recent_words(monkeypatch):
    """A full table of words keeps those of the texts just read, and ids stay those of the tokenizer."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    e = packing.Encoder(TOKENIZER)
    texts = ["It's naïve, the CAT sat", "the cat sat on a mat <|x|> 7e\u0301", "ÜBER über straße the cat"]
    for t in texts:
        assert e([t]) == [np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert {"the", "cat", "on", "über"} <= e.words.keys() and "CAT" not in e.words


def test_encoder_keeps_words_met_again(monkeypatch):
    """A full table keeps words met again since it was last full, also if the texts just read don't have them."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 8)
    e = packing.Encoder(TOKENIZER)
    for t in ("the cat sat", "the dog sat", "on my old mat by door", "another"):
        assert e([t]) == [np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert {"the", "sat", "another"} <= e.words.keys() and "cat" not in e.words


def test_encoder_windows_end_between_words(monkeypatch):
    """Windows of any size give the ids of the tokenizer, text by text, also if words are longer than they are."""
    rng, monkey = random.Random(4), [*"aZéÉß×µ07''stmdrevl!-<|>_\t\r   \n\n\x85\xa0你İé\x00", "<|endoftext|>", "'re", "'ll", "a" * 9, "\u0301"]
    texts = ["".join(rng.choice(monkey) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", " ", "'", "s", "'", "<", "|", "é"]
    want = None
    for window in (1, 7, 64, 1 << 23):
        monkeypatch.setattr(packing.Encoder, "WINDOW", window)
        e = packing.Encoder(TOKENIZER, 40)
        want = want or [np.asarray(i, "<u4").tobytes() for i in e._whole([t or "" for t in texts])]
        assert e(texts) == want
        assert e([]) == [] and e([None]) == [b""]


def test_encoder_spellings_of_known_parts_take_no_calls():
    """Words made of parts that are known are cut all at once: in Python they take no call each."""
    e, prof = packing.Encoder(TOKENIZER), cProfile.Profile()
    words = [a + b for a in "the of and on in er".split() for b in "ation ment ness ing ed".split()]
    e([" ".join(words) + " , . ! ; : 0 1 2 3 4 5 6 7 8 9"])
    text = " ".join(f"{w.title() if k % 2 else w}{mark}{k}" for w in words for mark in ",.!;:" for k in range(10))
    prof.enable()
    got = e([text] * 3)
    prof.disable()
    assert got == [np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()] * 3
    assert sum(f.callcount for f in prof.getstats()) < len(text.split())


def test_packing_cuts_every_batch_of_ids(spark):
    """Pieces of a batch come longest first, equally long ones in the order of the rows; empty texts are their end."""
    rows = [(1, "the " * 9), (None, None), (2, ""), (3, "the " * 4), (4, "the " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df, TOKENIZER, seq_len=4, end_id=5, open_bins=2).collect()
    assert [(r.doc_id, r.piece, r.start, r.length) for r in got] == [(1, 0, 0, 4), (1, 1, 4, 4), (3, 0, 0, 4), (4, 0, 0, 4), (1, 2, 8, 2), (None, 0, 0, 1), (2, 0, 0, 1), (3, 1, 4, 1)]
    assert [(r.sequence_id, r.offset) for r in got] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 2), (4, 3), (5, 0)]
    assert [np.frombuffer(r.ids, "<u4")[-1] for r in got[3:]] == [5] * 5


def test_repeats_free_their_shuffles(spark):
    """Once the tables are written, no shuffle of theirs is left on disk."""
    files = lambda: {str(b) for b in (lambda a: [a.apply(i).name() for i in range(a.size())])(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if str(b).startswith("shuffle_") and str(b).endswith("_0.data")}
    before = files()
    out = repeats.remove_repeats(spark.createDataFrame([(k, f"{k % 7} repeated " * 60) for k in range(40)], "doc_id long, text string"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 40


def test_driver_collects_garbage_when_its_heap_has_grown():
    """Once a table is written and the heap is over half its limit; a smaller heap is left alone."""
    done = []
    for size in (50, 51):
        runtime = SimpleNamespace(totalMemory=lambda n=size: n, maxMemory=lambda: 100)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda r=runtime: r), System=SimpleNamespace(gc=lambda n=size: done.append(n)))
        common.collect_garbage(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))))
    assert done == [51]


def test_training_holds_little():
    """Training holds a string a distinct word and small arrays of trigrams, not objects for every word of every text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(400)]
    tracemalloc.start()
    try:
        toxicity.train(texts, [k % 2 for k in range(400)], steps=40)
        assert tracemalloc.get_traced_memory()[1] < 45e6
    finally:
        tracemalloc.stop()


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs, TOKENIZER, seq_len=64, open_bins=8).collect()
    tok, want = Tokenizer.from_file(TOKENIZER), Counter()
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            want[(r[0], k // 64, k, tuple(ids[k : k + 64]))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, k in sorted(b):
            assert o == at
            at += k
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 64 + 8 * 3
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_best_fit_takes_tightest_and_closes_fullest():
    b = packing.BestFit(10, 2)
    assert [b.place(k) for k in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert b.place(5) == (2, 0) and b.place(6) == (3, 0) and b.place(8) == (4, 0)
    assert b.place(4) == (2, 5)  # 3, the fullest of (2, 3), was closed for 4


def test_encoder_agrees_with_tokenizer():
    e = packing.Encoder(TOKENIZER)
    texts = ["<|endoftext|>x", "ΟΔΟΣ", "e\u0301tat", "İ", "a\tb\x85c", "'S 'LL don't", "½ ² ½", None, ""]
    assert e.simple
    assert e(texts) == [np.asarray(i, "<u4").tobytes() for i in e._whole([t or "" for t in texts])]


def test_exact_groups(docs, none):
    rows = exact_dedup.exact_groups(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows)
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_bloom_lets_no_copy_through(docs):
    text = exact_dedup.normalised(docs.text)
    got = docs.select("text", exact_dedup.possibly_repeated(docs, text, max_bits=1 << 16).alias("m")).collect()
    count = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got)
    assert all(r.m for r in got if count[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")] > 1)


def removed_by_force(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                hit[i] += 1
                hit[i + size] -= 1
        out.append(np.cumsum(hit[:-1]) > 0)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes(docs, none, monkeypatch, small):
    if small:  # many blocks and chunks, texts in parts, many buckets
        for k, v in (("BLOCK", 3000), ("CHUNK", 500), ("BUCKET", 5000)):
            monkeypatch.setattr(repeats, k, v)
    rows = repeats.remove_repeats(docs).collect()
    texts = [(r[1] or "").encode() for r in ROWS]
    want = Counter()
    for r, t, gone in zip(ROWS, texts, removed_by_force(texts, 200), strict=True):
        starts = int((np.diff(gone, prepend=False) & gone).sum()) if len(t) else 0
        want[(r[0], len(t), np.frombuffer(t, np.uint8)[~gone].tobytes(), starts)] += 1
    assert want == Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in rows)
    assert repeats.remove_repeats(none).count() == 0


def components(rows, percent=80):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"cell_tokens": 400, "pivots": 16}])
def test_near_duplicates(docs, none, options):
    rows = jaccard_join.near_duplicates(docs, **options).collect()
    assert components(ROWS) == Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_near_duplicate_chains(spark):
    """Chains of ever more edits: neighbours link, ends don't; regions split over pivots find them all."""
    rng = random.Random(8)
    rows = []
    for c in range(4):
        w = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for i in range(12):
            w = list(w)
            w[rng.randrange(150)] = f"e{c}_{i}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"cell_tokens": 500, "pivots": 8}):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, **options).collect())
        assert got == components(rows)


def test_drop_near_copies_loses_no_component(spark):
    """Null ids, one id with several texts, and equal rows: one row of every component stays."""
    w = [[f"{c}{i}" for i in range(40)] for c in "abcdefg"]
    near = lambda c, k: " ".join([*w[c][:-k], *["edited"] * k])
    text = [" ".join(x) for x in w]
    rows = [
        (None, text[0], "s"), (None, near(0, 1), "t"),  # null ids only
        (None, text[1], "s"), (4, near(1, 1), "s"),  # a null id gives way to another
        (5, text[2], "s"), (5, text[3], "s"),  # one id, different texts
        (3, near(3, 1), "s"),  # ... of which one is a near copy of a smaller id
        (7, text[4], "s"), (7, text[4], "s"), (7, text[4], None), (None, text[5], None), (None, text[5], None),
        (8, None, "s"), (None, "", "s"), (None, "one", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for options in ({}, {"cell_tokens": 30, "pivots": 8}):
        got = [tuple(r) for r in jaccard_join.drop_near_copies(df, **options).collect()]
        assert not Counter(got) - Counter(rows)
        ids = Counter((r[0], (r[1] or "").split(" ")[0]) for r in got)
        assert ids == Counter([(None, "a0"), (4, "b0"), (5, "c0"), (3, "d0"), (7, "e0"), (None, "f0"), (8, ""), (None, ""), (None, "one")])


def test_connected(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300) if i % 50] + [(rng.randrange(300), 1000) for _ in range(3)]
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root}


def test_blobs():
    rng = np.random.default_rng(1)
    for v in (np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.zeros(0, np.uint64), np.arange(9, dtype=np.uint64)):
        assert (blobs.unpack(blobs.pack(v)) == v).all()
    v = rng.integers(0, 60000, 100).astype(np.uint16)
    assert (blobs.unpack(blobs.pack(v), False) == v).all()


def test_secrets():
    text = 'x = 1; PassWord: "abc123"; token=ab; key AKIA' + "Z" * 16 + " AKIA123 " + "0a" * 12 + " secret='k"
    found = secrets.find_secrets(text)
    assert [f[:3] for f in found] == [("assign", 7, 24), ("access", 41, 61), ("hex", 70, 94)]
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    novel = secrets.find_secrets(f"the private auth value is {key} as said")
    assert [f[:3] for f in novel] == [("novel", 26, 66)]
    assert not secrets.find_secrets("the token here is thetionthetionthetion1thetionthetion and more thetion")
    assert not secrets.find_secrets(f"nothing of that kind: {key}")
    assert not secrets.find_secrets("")


def test_secrets_in_key_value_text():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(letters) for _ in range(40))
    far = " plain words of no use here" * 30
    for text in (f"AWS_ACCESS_KEY={key}", f"private_key={key}==", f"auth={key}", f"http://a.b/c?x=1&signature={key}", f"export CREDENTIAL={key}\n", f"client_secret-{key}", f"{key} is the private value", f"[credentials]{far}\nname = {key}", f"{key}{far} bearer"):
        found = secrets.find_secrets(text)
        assert [text[s:e].rstrip("=") for kind, s, e, _ in found if kind == "novel"] == [key], text
    for gap in (" ", " and again ", " x" * 100, " y" * 118):  # the last ones reach over the window's edge
        text = f"auth={key}{gap}auth={key}{gap}auth={key}"
        assert [text[s:e] for _, s, e, _ in secrets.find_secrets(text)] == [key] * 3
    assert not secrets.find_secrets("auth=" + "authorization_response_header_1_application")


def test_secret_scan_rows(docs, none):
    assert secrets.scan_secrets(docs).count() == len(ROWS)
    assert secrets.scan_secrets(none).count() == 0


def test_html_blocks():
    model = html.fit(html.labelled_pages())
    page = "<html><body><nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>T&amp;t</h1><p><b>One\n two<br><p>Three <a href=y>link</a> and more words here<script>var x='</p>'</script></article><div class='comments'><p>no</p></div><footer>&copy; foot</footer>"
    assert html.main_text(page, model) == "T&t\nOne two\nThree link and more words here"
    assert html.main_text(None, model) == html.main_text("", model) == ""
    good = total = 0
    for p in html.labelled_pages(40, seed=77):
        nodes, blocks = html.parse(p)
        m = html.marginals(nodes, model)
        good += sum((m[i] >= 0.5) == bool(nodes[i].keep) for i, _ in blocks)
        total += len(blocks)
    assert good / total > 0.93


def test_messages_give_exact_marginals():
    """Sum-product against summing over all labellings of a small tree."""
    import itertools
    import math

    model = html.fit(html.labelled_pages())
    nodes, _ = html.parse("<div class=content><p>some words of text</p><div><a href=x>a b</a></div></div>")
    inner = range(1, len(nodes))
    got = html.marginals(nodes, model)
    # the root has no preference of its own
    first = next(i for i in inner if nodes[i].parent == 0)
    assert 0 <= min(got) and max(got) <= 1
    w = []
    for a in (0, 1):
        s = 0.0
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            if labels[first] == a and labels[0] == 0:
                e = sum(sum(model["seen"].get(f, (0, 0))[labels[i]] for f in html.seen(nodes[i])) + (model["step"][labels[nodes[i].parent]][labels[i]] if nodes[i].parent else 0.0) for i in inner)
                s += math.exp(e)
        w.append(s)
    assert got[first] == pytest.approx(w[1] / sum(w), rel=1e-6)


def test_gru_gradient():
    net, rng = toxicity.Network({"a": 1}, np.zeros(1, np.float32)), np.random.default_rng(0)
    x, mask, y = rng.standard_normal((5, 6, 12)).astype(np.float32), np.ones((5, 6), np.float32), np.array([0, 1, 1, 0, 1, 0], np.float32)
    mask[3:, 2] = 0

    def loss():
        p = net.p
        s = np.concatenate([toxicity.gates(x @ p["w" + d] + p["b" + d], mask, p["u" + d], d == "1")[0] for d in "01"], 2)
        z = net.pool(s, mask)[3].astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g, _ = net.gradient(x, mask, y)
    for k, v in g.items():
        i = int(np.abs(v).argmax())
        p = net.p[k].ravel()
        old = p[i]
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        down = loss()
        p[i] = old
        assert (up - down) / 2e-2 == pytest.approx(float(v.ravel()[i]), abs=2e-3)


def test_windows_cover_all():
    for n in (0, 1, 23, 24, 25, 36, 100, 1001):
        s = toxicity.windows(n)
        assert set(range(n)) <= {i for a in s for i in range(a, a + toxicity.WINDOW)} and all(b - a <= toxicity.STEP for a, b in zip(s, s[1:]))


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an")) for _ in range(rng.randint(1, 4)))
    rows, marks = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randint(5, 120))]
        if bad := i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(("vile", "rotten", "foul"))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == marks[r.doc_id][2] for r in held) / len(held) > 0.9
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    nobody = labels.filter("false")
    plain = toxicity.score_documents(docs, nobody).collect()
    assert len(plain) == len(ROWS) and {r.predicted for r in plain} == {0}
    assert toxicity.score_documents(none, nobody).count() == 0


def test_url_trees_in_sql_match(spark):
    model = urls.fit(urls.labelled_urls())
    probe = [u for u, _ in urls.labelled_urls()] + ["no scheme", "", None, "https://UPPER.Example.ORG/es/1?x#y", "x://", "a://b?c=d&e", "ftp://example.org/en/12", "https://de.com/de/", "http://a.com/fr/x"]
    got = urls.judge_urls(spark.createDataFrame([(i, u, "") for i, u in enumerate(probe)], "page_id long, url string, host string")).collect()
    for r in got:
        u = probe[r.page_id] or ""
        assert (r.host, r.path) == urls.split_url(u)
        assert r.score == pytest.approx(urls.predict(model, u), abs=1e-5)
        fits = [(len(h), len(p), v, h + p) for v, h, p in urls.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.rule == (max(fits)[3] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if urls.predict(model, u) > 0 else "allow")
    right = sum((urls.predict(model, u) > 0) == bool(b) for u, b in urls.labelled_urls())
    assert right / len(urls.labelled_urls()) > 0.95


def test_url_trees_use_other_features():
    rows = [(f"http://site.net/{'9' * (i % 12)}/{'a/' * (i % 4)}", int(i % 12 > 6)) for i in range(120)]
    model = urls.fit(rows)
    assert sum((urls.predict(model, u) > 0) == bool(b) for u, b in rows) > 115


def test_built_in_url_trees_split_on_several_features():
    used = lambda t: [] if len(t) == 1 else [urls.FEATURES[t[0]], *used(t[2]), *used(t[3])]
    model = urls.fit(urls.labelled_urls())
    by = Counter(f for t in model["trees"] for f in used(t))
    assert len(by) >= 5 and max(by.values()) <= 0.5 * sum(by.values())
    for feature in range(len(urls.FEATURES)):  # no feature separates the labels alone
        rows = sorted((urls.features(u, model["suffixes"], model["prior"])[feature], b) for u, b in urls.labelled_urls())
        low = {b: [x for x, y in rows if y == b] for b in (0, 1)}
        assert min(low[0]) <= max(low[1]) and min(low[1]) <= max(low[0])
    other = urls.labelled_urls(seed=99, of_each=500)
    assert sum((urls.predict(model, u) > 0) == bool(b) for u, b in other) / len(other) > 0.8
    names = ("casino", "win", "bets", "cheap", "pills", "ads", "track", "spam", "farm", "adult", "example", "utm_source", "ref=x")
    assert not [u for u, _ in urls.labelled_urls() if any(n in re.split(r"[^a-z_=]+", u) for n in names)]


def test_mixing(docs, none):
    rows = mixing.taken_words(docs, block_words=16, shard_blocks=20, bin_blocks=8).collect()
    again = mixing.taken_words(docs.repartition(7), block_words=16, shard_blocks=20, bin_blocks=8).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == len(ROWS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, by = 0, {}
    for r in ROWS:
        total += size(r[1])
        by[r[3]] = by.get(r[3], 0) + size(r[1])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = 1.5 * total - sum(2 * by[s] for s in full)
        target = {s: 2 * by[s] if s in full else left * weight[s] / sum(weight[t] for t in by if t not in full) for s in by}
        over = {s for s in by if target[s] > 2 * by[s]} - full
        if not over:
            break
        full |= over
    got = {}
    ids = {}
    for r in ROWS:
        ids.setdefault((r[0], size(r[1])), set()).add(r[3])
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        source = next(s for s in ids[(r.doc_id, r.size)] if by[s] == r.source_size)
        assert r.target == pytest.approx(target[source])
        got[source] = got.get(source, 0) + r.taken
    for s in by:
        assert abs(got.get(s, 0) - target[s]) <= 1
    assert mixing.taken_words(none).count() == 0


def test_placements_are_disjoint_and_dense(docs):
    _, placed = mixing.place_blocks(docs, block_words=16, shard_blocks=20, bin_blocks=8)
    rows = placed.collect()
    spots = {}
    for r in rows:
        spots.setdefault(r.shard, []).append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in spots.values()) and len(spots) > 3
    sizes = [len(p) for p in spots.values()]
    assert max(sizes) - min(sizes) <= 4
    assert len({(r.doc_id, r.source, r.size, r.copy, r["pass"], r.block) for r in rows}) == len(rows)


def test_mixed_documents_hold_what_is_taken(docs):
    options = dict(block_words=300, shard_blocks=5, bin_blocks=8)
    out = mixing.mix_documents(docs, **options)
    assert out.columns == docs.columns
    spark = docs.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # so that all runs are in one partition
    words, found = Counter(), out.collect()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    starts = mixing.place_blocks(docs, **options)[1].groupBy("shard", "doc_id", "source", "size", "copy", "pass").agg({"position": "min"}).orderBy("shard", "min(position)").collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in starts]  # in order of shard and place
    for r in found:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.taken_words(docs, **options).collect():
        want[r.doc_id] += r.taken
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert words == Counter({k: v for k, v in want.items() if v})


def test_hypergeometric_and_tree():
    draws = [mixing.hypergeometric(mixing.uniform(1, k, 0), 30, 70, 20) for k in range(4000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.15) and np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.12)
    assert mixing.hypergeometric(0.5, 10**9, 10**9, 10**6) == pytest.approx(500_000, abs=10_000)
    shards = mixing.split_tree([100, 7, 0, 53], 7, 3)
    assert [sum(c) for c in zip(*shards)] == [100, 7, 0, 53] and max(map(sum, shards)) - min(map(sum, shards)) <= 2


def test_tree_decides_what_shards_hold(docs, monkeypatch):
    """The tree's counts are those of the blocks in the shards, and another tree gives another result."""
    options = dict(block_words=16, shard_blocks=20, bin_blocks=8)
    counts, real = [], mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: counts.append(real(*a)) or counts[-1])
    placed = mixing.place_blocks(docs, **options)[1].collect()
    seen = Counter((r.shard, r.source) for r in placed)
    assert [sorted(v for (s, _), v in seen.items() if s == i) for i in range(len(counts[0]))] == [sorted(x for x in c if x) for c in counts[0]]
    before = Counter(map(tuple, mixing.taken_words(docs, **options).collect()))
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: [quotas] + [[0] * len(quotas)] * (shards - 1))
    assert before != Counter(map(tuple, mixing.taken_words(docs, **options).collect()))


def test_mixing_sql(spark, tmp_path):
    """The registered query against its SQL, on rows with nulls, copies and clashing columns; several shards."""
    import duckdb

    rng = random.Random(12)
    rows = [(i if i % 50 else None, " ".join(["w"] * rng.choice((0, 3, 900, 2500))), f"s{i % 4}" if i % 9 else None, "x", i) for i in range(700)] + [(7, "same words", "s1", "x", 1)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, size long").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.taken_words(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT doc_id, size, source_size, target, taken, shards FROM ({mixing.ORACLE})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len({x.split(":")[0] for r in want for x in r[5].split(",")}) > 4


def spots_by_force(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    anchors, out = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in anchors:
            rest = [x for x in words[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
            if len(rest) == spotsigs.CHAIN:
                out.add((w, *rest))
    return out


def test_spots(docs, none):
    df = spotsigs.with_spots(docs, "text", "spots")
    seen = {}
    for r in df.collect():
        want = spots_by_force(r.text)
        assert len(r.spots) == max(1, len(want)) and r.spots == sorted(r.spots)
        assert seen.setdefault(r.text or "", r.spots) == r.spots
    assert spotsigs.with_spots(none, "text", "spots").count() == 0


def test_spot_links(spark):
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 1003]
    df = spotsigs.with_spots(spark.createDataFrame(rows, "doc_id long, text string"), "text", "spots")
    sets = {}
    for r in df.collect():
        k = tuple(r.spots)
        sets[k] = min(sets.get(k, r.doc_id), r.doc_id)
    want = set()
    for a, i in sets.items():
        for b, j in sets.items():
            if i < j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
                want.add((i, j))
    assert {(r.left, r.right) for r in spotsigs.spot_links(df).collect()} == want


@pytest.mark.parametrize("options", [{}, {"rows_per_bucket": 2, "max_cuts": 5}, {"rows_per_bucket": 3, "max_cuts": 1000}])
def test_next_text(docs, none, options):
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = spotsigs.with_next(docs, **options).collect()
    want = Counter((i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows))
    assert want == Counter((r.doc_id, r.text, r.next_text) for r in got)
    assert spotsigs.with_next(none).count() == 0
