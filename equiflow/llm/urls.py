"""URL verdicts: host rules, and gradient-boosted trees on lexical features, in SQL functions only.

The trees are fitted on the driver from a bounded list of labelled URLs and become one Column
expression, so judging stays in generated code and nothing but the scan is needed.
"""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Names of shops, offers and sites; none is a word of the pages that this is tried on.
_OFFERS = "loan deal prize bonus poker slots credit diet replica coupon ringtone lottery jackpot dating miracle outlet rebate voucher".split()
_SITES = "garden museum history science weather library school travel recipe music football forest river theatre harbour village college gallery".split()
_PLAIN = "north old city st central green lake open first grand royal little".split()
_SLUGS = "opening hours council meeting minutes summer timetable annual report visit guide members notes review letters results".split()
_SHARED = (("co.uk", 5), ("github.io", 3), ("edu.au", 1), ("web.app", 4), ("blogspot.com", 5), ("cf.page", 6))  # how often of 10 a host here is an offer's


def _draw(rng: random.Random, block: bool) -> str:
    """A URL of either kind. All that a feature counts occurs in both, more often in one than in the other."""
    pick, chance = lambda xs: xs[rng.randrange(len(xs))], lambda k: rng.randrange(10) < k
    names = _OFFERS if block else _SITES
    name = pick(names)
    if chance(7):
        other = pick(_PLAIN) if chance(4) else pick(names)
        name = f"{other}{'-' if chance(7 if block else 4) else ''}{name}"
    if block and chance(2):
        name += f"-{pick(names)}"
    if chance(6 if block else 1):
        name += str(rng.randrange(1, 1000 if block else 100))
    sub = pick(("", "", "www.", "www.", "shop.", "go.") if block else ("", "", "www.", "www.", "news.", "docs."))
    if chance(3 if block else 1):
        sub = "".join(pick("bcdfghjkmnpqrstvwxz0123456789") for _ in range(rng.randrange(4, 12))) + "." + sub
    hosts = [h for h, k in _SHARED for _ in range(k if block else 10 - k)]
    host = f"{sub}{name}.{pick(hosts) if chance(5) else pick(('com', 'org', 'net', 'info'))}"
    depth = rng.randrange(0, 3) if block else rng.randrange(0, 5)
    path = "".join("/" + (str(rng.randrange(2010, 2026)) if chance(2) else "-".join(pick(_SLUGS) for _ in range(rng.randrange(1, 4)))) for _ in range(depth))
    if chance(7 if block else 1):
        path += "/" + "".join(pick("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPRSTUVW0123456789") for _ in range(rng.randrange(6, 20)))
    keys = ("aff", "cid", "sub", "click", "src", "id") if block else ("p", "lang", "sort", "id", "section", "year")
    query = "&".join(f"{pick(keys)}={rng.randrange(10 ** rng.randrange(1, 9 if block else 5))}" for _ in range(rng.randrange(0, 6 if block else 3)))
    return f"http{'s' * chance(4 if block else 8)}://{host}{path or '/'}{pick(('', '', '/', '.htm')) if path else ''}{'?' + query if query else ''}"


def labelled_urls(seed: int = 1, of_each: int = 150) -> list[tuple[str, int]]:
    """The built-in labelled list (1: block), made by rule; other seeds give lists to try the trees on."""
    rng = random.Random(seed)
    return [(_draw(rng, bool(b)), b) for _ in range(of_each) for b in (1, 0)]


FEATURES = ("length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix")


def _suffix(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def split_url(url: str) -> tuple[str, str]:
    """Host and path as the contract states them, for fitting; Columns do the same in ``host_path``."""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def features(url: str, suffixes: dict[str, float], prior: float) -> list[float]:
    host, path = split_url(url)
    n = max(1, len(url))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values()) if url else 0.0
    return [len(url), path.count("/"), sum(c in "0123456789" for c in url) / n, round(entropy, 6), url.count("&") + url.count("="), host.count("-"), host.count("."), suffixes.get(_suffix(host), prior)]


def _grow(rows: list, grad: list[float], hess: list[float], idx: list[int], depth: int) -> tuple:
    g, h = sum(grad[i] for i in idx), sum(hess[i] for i in idx)
    best = (1e-6, None, None)
    if depth:
        for f in range(len(FEATURES)):
            order = sorted(idx, key=lambda i: rows[i][f])
            gl = hl = 0.0
            for a, b in zip(order, order[1:], strict=False):
                gl, hl = gl + grad[a], hl + hess[a]
                if rows[a][f] < rows[b][f]:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, (rows[a][f] + rows[b][f]) / 2)
    if best[1] is None:
        return (round(g / (h + 1), 5),)  # half of it has 6 digits, so scores rounded to 6 have no ties
    _, f, cut = best
    return (f, round(cut, 5), _grow(rows, grad, hess, [i for i in idx if rows[i][f] < round(cut, 5)], depth - 1), _grow(rows, grad, hess, [i for i in idx if rows[i][f] >= round(cut, 5)], depth - 1))


def _value(tree: tuple, x: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[0]


def fit(labelled: list[tuple[str, int]], trees: int = 12, depth: int = 3, rate: float = 0.5) -> dict:
    """Logistic gradient boosting over the lexical features; ``labelled`` is a bounded list."""
    y = [b for _, b in labelled]
    prior = sum(y) / max(1, len(y))
    seen: dict[str, list[int]] = {}
    for u, b in labelled:
        seen.setdefault(_suffix(split_url(u)[0]), []).append(b)
    suffixes = {s: round((sum(v) + 4 * prior) / (len(v) + 4), 6) for s, v in seen.items() if len(v) >= 3}
    rows = [features(u, suffixes, round(prior, 6)) for u, _ in labelled]
    score, grown = [0.0] * len(y), []
    for _ in range(trees if len(set(y)) == 2 else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(rows, [a - b for a, b in zip(y, p, strict=True)], [q * (1 - q) for q in p], list(range(len(y))), depth)
        grown.append(tree)
        score = [s + rate * _value(tree, x) for s, x in zip(score, rows, strict=True)]
    return {"trees": grown, "rate": rate, "suffixes": suffixes, "prior": round(prior, 6)}


def predict(model: dict, url: str) -> float:
    x = features(url, model["suffixes"], model["prior"])
    return sum(model["rate"] * _value(t, x) for t in model["trees"])


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tree_sql(tree: tuple) -> str:
    if len(tree) == 1:
        return f"CAST({tree[0]!r} AS DOUBLE)"
    return f"(CASE WHEN f_{FEATURES[tree[0]]} < CAST({tree[1]!r} AS DOUBLE) THEN {_tree_sql(tree[2])} ELSE {_tree_sql(tree[3])} END)"


def _score_sql(model: dict) -> str:
    return " + ".join(f"CAST({model['rate']!r} AS DOUBLE) * {_tree_sql(t)}" for t in model["trees"]) or "CAST(0 AS DOUBLE)"


def judge_urls(pages: DataFrame, model: dict | None = None, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host,
    then the longest path, wins. Without a rule the trees decide (block at a score above 0). A url
    that is null or has no ``://`` has an empty host and path and is judged by the trees as an
    empty or whole string. Repeated rows are judged each; a null page_id stays null; other columns are
    ignored; an empty table gives no rows.
    """
    model = model or fit(labelled_urls())
    u = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_path(u)
    df = pages.select(F.col("page_id"), u.alias("u"), host.alias("host"), path.alias("path"))
    n = F.greatest(F.length("u"), F.lit(1)).cast("double")
    letters = F.split("u", "")
    share = lambda c: (F.length("u") - F.length(F.replace(F.col("u"), c))) / n
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s - share(c) * F.log2(share(c))))
    count = lambda col, c: F.length(col) - F.length(F.replace(F.col(col), F.lit(c)))
    parts = F.split("host", r"\.")
    suffix = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")
    stats = F.coalesce(*[F.when(suffix == s, F.lit(v)) for s, v in sorted(model["suffixes"].items())], F.lit(model["prior"]))
    df = df.select("*", F.length("u").cast("double").alias("f_length"), count("path", "/").cast("double").alias("f_depth"), (F.length(F.regexp_replace("u", "[^0-9]", "")) / n).alias("f_digits"), F.round(entropy, 6).alias("f_entropy"), (count("u", "&") + count("u", "=")).cast("double").alias("f_params"), count("host", "-").cast("double").alias("f_hyphens"), count("host", ".").cast("double").alias("f_labels"), stats.alias("f_suffix"))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2])))
    which = F.coalesce(*[F.when(fits(h, p), F.lit(k)) for k, (_, h, p) in enumerate(longest)])
    df = df.withColumn("which", which).withColumn("score", F.expr(_score_sql(model)))
    pick = lambda f: F.get(F.array(*[F.lit(f(r)) for r in longest]), F.col("which"))
    by_trees = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", pick(lambda r: r[1] + r[2]).alias("rule"), F.coalesce(pick(lambda r: r[0]), by_trees).alias("verdict"), F.round("score", 6).alias("score"))


def oracle(model: dict | None = None, rules: tuple = RULES) -> str:
    model = model or fit(labelled_urls())
    longest = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2])))
    when = lambda f: " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{f(r)}'" for r in longest)
    stats = " ".join(f"WHEN '{s}' THEN CAST({v!r} AS DOUBLE)" for s, v in sorted(model["suffixes"].items()))
    score = _score_sql(model)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, greatest(1, length(u)) AS n FROM a),
c AS (SELECT *, length(u)::DOUBLE AS f_length, (length(path) - length(replace(path, '/', '')))::DOUBLE AS f_depth,
  length(regexp_replace(u, '[^0-9]', '', 'g')) / n AS f_digits,
  round(coalesce(list_sum(list_transform(list_filter(list_distinct(string_split(u, '')), lambda x: x <> ''), lambda x: -((length(u) - length(replace(u, x, ''))) / n) * log2((length(u) - length(replace(u, x, ''))) / n))), 0), 6) AS f_entropy,
  (2 * length(u) - length(replace(u, '&', '')) - length(replace(u, '=', '')))::DOUBLE AS f_params,
  (length(host) - length(replace(host, '-', '')))::DOUBLE AS f_hyphens, (length(host) - length(replace(host, '.', '')))::DOUBLE AS f_labels,
  CASE array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 1), NULL), '.') {stats} ELSE CAST({model['prior']!r} AS DOUBLE) END AS f_suffix FROM b),
d AS (SELECT *, {score} AS s FROM c)
SELECT page_id, host, path, CASE {when(lambda r: r[1] + r[2])} END AS rule, CASE {when(lambda r: r[0])} WHEN s > 0 THEN 'block' ELSE 'allow' END AS verdict, round(s, 6) AS score FROM d
"""
