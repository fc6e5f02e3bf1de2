"""The registered queries on a small folder of tables, their digest columns against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from equiflow.llm import html, queries, secrets, spotsigs  # noqa: E402

from .test_operators import ROWS, components, removed_by_force, spots_by_force  # noqa: E402

KEY = (lambda r: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)))(random.Random(4))
SECRETS = ["PassWord: 'abc123' and token=ab; é AKIA" + "Z" * 16, "0a" * 12 + " secret = k-9_zz77 " + "f" * 23 + "e", f"the private auth value is {KEY} as said", f"api key: {KEY}", "\n" * 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(r[0], r[1], None, r[3], 0, r[1], -1, "x") for r in ROWS] + [(3000 + i, t, "en", "s1", 0, "x", 1, None) for i, t in enumerate(SECRETS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, start long, fingerprint string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i * 3, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(0, "http://a.example.org/es/x", "<body><nav><a href=x>menu</a></nav><article><h1>A&amp;b</h1><p>One  two\n three four five six seven eight.</p><form><p>Your name and address here please</p></form></article></body>"), (1, None, None), (None, "x", ""), (2, "no scheme", "plain text alone"), (2, "no scheme", "plain text alone")]
    spark.createDataFrame([(*p, "t", 5) for p in pages], "page_id long, url string, html string, text string, n_chars long").write.parquet(f"{at}/pages.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    return at, empty, [(r[0], r[1] or "") for r in rows]


def run(spark, name, at):
    return queries.QUERIES[name](spark, at).collect()


def test_packing_query(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in folder[2]:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.asarray(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = run(spark, "op1_best_fit_packing", folder[0])
    order = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)


def test_fingerprint_query(spark, folder):
    rows = sorted(folder[2], key=lambda r: r[1], reverse=True)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]

        def like(x):
            if x == t:
                return 1.0
            a, b = spots_by_force(t), spots_by_force(x)
            words = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
            a, b = a or {words(t)}, b or {words(x)}
            j = len(a & b) / len(a | b)
            return j if j >= queries.LEAST_LIKENESS else 0.0

        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(edited), 9), round(like(after), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in run(spark, "op2_spotsigs", folder[0])]
    order = lambda x: (x[0] is None, *(v or 0 for v in x[:2]), *x[2:])
    assert sorted(got, key=order) == sorted(want, key=order)
    prints = {}
    for (_, t), r in zip(sorted(folder[2], key=lambda x: (x[0] is None, x[0] or 0, x[1])), sorted(run(spark, "op2_spotsigs", folder[0]), key=lambda x: (x.doc_id is None, x.doc_id or 0, x.n_chars))):
        prints.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_length_ranges_lose_nothing(spark):
    """Sets in ranges further apart than neighbours can't be as alike as the bound."""
    pairs = [(list(range(n)), list(range(m))) for n in range(1, 60) for m in range(1, 60, 3)]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    for least in (0.05, 0.5, 0.8):
        for r in df.select("a", "b", spotsigs.pruned_likeness(df.a, df.b, least).alias("j")).collect():
            true = min(len(r.a), len(r.b)) / max(len(r.a), len(r.b))
            assert r.j == pytest.approx(true if true >= least else 0.0)


def test_secret_query(spark, folder):
    base = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24))
    want = []
    for i, t in folder[2]:
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, flags, g, least) in enumerate(base) for m in re.compile(p, flags | re.ASCII).finditer(t) if len(m[g]) >= least)
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        want.append((i or -1, *n, hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()))
    got = run(spark, "op3_secret_scan", folder[0])
    assert sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    novel = {r.doc_id: r.spans for r in got if r.n_novel}
    assert novel == {3002: "novel:26:66", 3003: "novel:9:49"}


def test_keys_of_letters_alone():
    rng = random.Random(5)
    mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(36))
    assert [s[:3] for s in secrets.find_secrets(f"bearer {mixed}")] == [("novel", 7, 43)]
    assert not secrets.find_secrets("the token of internationalization and incomprehensibilities, see getAuthorizationHeader")
    assert not secrets.find_secrets("auth: " + "-" * 40)


def test_repeats_query(spark, folder):
    texts = [t.encode() for _, t in folder[2]]
    want = []
    for (i, _), t, gone in zip(folder[2], texts, removed_by_force(texts, 200), strict=True):
        spans = int((np.diff(gone, prepend=False) & gone).sum()) if len(t) else 0
        want.append((i or -1, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op4_repeated_bytes", folder[0])) == sorted(want)


def test_page_query(spark, folder):
    got = run(spark, "op6_html_extraction", folder[0])
    key = lambda r: (r[0] is None, r[0] or 0)
    main = "A&b\nOne two three four five six seven eight."
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=key) == [(0, "http://a.example.org/es/x", main, len(main)), (1, None, "", 0), (2, "no scheme", "plain text alone", 16), (2, "no scheme", "plain text alone", 16), (None, "x", "", 0)]


def test_deep_pages_take_linear_time():
    import time

    model = html.fit(html.labelled_pages())
    took = []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        html.main_text("<div>x" * n, model)
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 0.5


def test_join_and_dedup_queries(spark, folder):
    rows = [(i, t) for i, t in folder[2]]
    assert components(rows) == __import__("collections").Counter((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op10_jaccard_join", folder[0]))
    assert sum(r.kept for r in run(spark, "op9_exact_dedup", folder[0])) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in rows})
    for name in ("op5_mixing", "op7_toxicity"):
        assert len(run(spark, name, folder[0])) == len(rows)


def test_empty_tables(spark, folder):
    for name in queries.QUERIES:
        assert run(spark, name, folder[1]) == [], name
