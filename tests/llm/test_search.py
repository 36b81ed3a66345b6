"""Lexical search, exact top-k and spelling variants against plain Python and SQL."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tests_llm_prose import prose
from tidewater.llm import exact_topk, lexical, spelling

TERM = re.compile(lexical.TERM)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k=50):
    words = [(d, TERM.findall(lowered(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    counts = [(d, len(w), Counter(w)) for d, w in words]
    df = Counter(x for _, _, c in counts for x in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, n, c in counts:
            m = 50 + 50 * n * n_docs // n_terms if n_terms else 50
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in set(TERM.findall(lowered(text))) if c[x])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


DOCS = [
    *[(i, prose(30 + i % 7 * 40, i)) for i in range(300, 420)],
    *[(i, "same words in all of these") for i in range(60)],
    (60, "same words in all of these"),
    (60, "same words in all of these"),
    (61, None),
    (62, ""),
    (63, " .,; "),
    (None, "same words in all of these"),
    (64, "ÉCOLE Été 12ab WORDS!words"),
    (65, prose(20_000, 5)),
]
ITEMS = [(1, "same words"), (2, prose(30, 301)), (3, None), (4, "nowhere-at-all zzzzzzzzz"), (5, "ÉCOLE été Words 12AB"), (6, prose(25, 5) + " same"), (6, prose(25, 5) + " same"), (None, "these of all")]


def as_docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, shard int, term string").repartition(5)


@pytest.mark.parametrize("shard", [4000, 1 << 20])
def test_search_is_that_of_all_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    items = spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, rank int")
    found = lexical.search(lexical.inverted_index(as_docs(spark, DOCS), shard=shard), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == ranked(DOCS, ITEMS)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.inverted_index(as_docs(spark, [])), items).count() == 0
    assert lexical.search(lexical.inverted_index(as_docs(spark, DOCS[:3])), items.limit(0)).count() == 0


def test_best_positions_stop_early():
    """A document that leads both lists by far ends the search before the lists do."""
    import numpy as np

    n = 5000
    impact = np.r_[10**6, np.arange(n - 1, 0, -1)].astype(np.int64)
    lists = [(impact, np.r_[7, np.delete(np.random.default_rng(i).permutation(n), 0) % n]) for i in range(2)]
    lists = [(v, np.array(list(dict.fromkeys(d.tolist() + list(range(n)))))[:n]) for v, d in lists]
    docs, scores = lexical._best(lists, n, np.zeros(0, np.int64), 1)
    assert len(docs) < n / 10 and docs[scores.argmax()] == 7 and scores.max() == 2 * 10**6


def nearest(rows, k=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q is not None and q % 50 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i) for b, (i, w) in enumerate(kept) if b != a and len(w) == len(v)))
            out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(scores[:k], 1)]
    return Counter(out)


def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    hot = [0.5, -0.25] * 4
    rows += [(i, hot) for i in range(1000, 1300)]
    rows += [(50, hot), (50, hot), (None, hot), (2000, None), (2050, [None] + [0.1] * 7), (2100, [float("nan")] + [0.1] * 7), (2150, [float("inf")] * 8), (2200, [0.1, 0.2]), (2201, [0.3, 0.1]), (2250, [])]
    return rows


@pytest.mark.parametrize("scale", [1, 3000, 2e6])
def test_topk_is_that_of_all_scores(spark, monkeypatch, scale):
    monkeypatch.setattr(exact_topk, "MOST", 7)
    rows = [(i, v and [x if x is None else x * scale for x in v]) for i, v in vectors()]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(6)
    found = exact_topk.top_k(df, df.filter("vec_id % 50 = 0"))
    assert Counter(map(tuple, found.collect())) == nearest(rows)


def test_topk_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 0.4])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in exact_topk.top_k(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert exact_topk.top_k(few.limit(0), few.limit(0)).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        exact_topk.top_k(few.selectExpr("vec_id", "transform(embedding, x -> double(x) * 1e30) as embedding"), few)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelled(rows):
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(set)
    for a in words:
        cuts = [(a[:i], a[i:]) for i in range(len(a) + 1)]
        letters = {c for w in words for c in w}
        made = {x + y[1:] for x, y in cuts if y} | {x + c + y[1:] for x, y in cuts if y for c in letters} | {x + c + y for x, y in cuts for c in letters}
        near[a] = {b for b in made if b in words and b != a}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 5 * words[a] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), c, len(near[w]), form[w] and words[form[w]]) for w, c in words.items())


def spelling_rows():
    rng = random.Random(4)
    base = ["variant", "spelling", "colour", "éclairé", "ÀÿGRAVE", "banana", "ananas", "aabbcc", "abcabc", "ccbbaa", "mississippi"]
    rows = []
    for d in range(150):
        words = []
        for w in base:
            words += [w] * rng.randint(0, 9)
            for _ in range(2):
                i = rng.randrange(len(w))
                words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeß÷") + w[i + 1 :], w[:i] + rng.choice("ae") + w[i:]]))
        rng.shuffle(words)
        rows.append((d, "-".join(words)))
    chain = ["a" * k + "b" * (12 - k) for k in range(13)]
    rows += [(1000 + k, " ".join([w] * 5 ** min(k, 5))) for k, w in enumerate(chain)]
    return [*rows, (None, "variant variant 日本語 variantÉ"), (3, None), (4, ""), (5, "日本 " + "x" * 50_000), (6, "colour " * 9), (6, "colour " * 9)]


@pytest.mark.parametrize("crowd", [2, 1000])
def test_spelling_is_that_of_all_edits(spark, monkeypatch, crowd):
    rows = spelling_rows()
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (crowd,))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(4)
    found = spelling.variants(spelling.word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
    assert Counter(map(tuple, found.collect())) == spelled(rows)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.word_counts(as_docs(spark, [(1, None)]))).count() == 0


@pytest.mark.parametrize("query, sql, tables", [(lexical.op11_lexical_search, lexical.OP11_SQL, ["documents", "benchmark"]), (exact_topk.op12_exact_topk, exact_topk.OP12_SQL, ["embeddings"]), (spelling.op13_spelling_variants, spelling.OP13_SQL, ["documents"])])
def test_matches_sql(spark, sf, query, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    found = query(spark, sf)
    want = con.sql(sql).select(*found.columns)
    assert Counter(map(tuple, found.collect())) == Counter(want.fetchall())
