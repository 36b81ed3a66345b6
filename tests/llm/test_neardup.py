"""Near-duplicates against all pairs in plain Python."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests_llm_prose import prose, vary
from tidewater.llm import neardup, shingles


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows, threshold=0.8):
    """Least id of each component of the pairs that share a shingle and are alike."""
    bags = {i: bag(t) for i, t in rows if i is not None}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in sorted(bags):
        for s in bags[i]:
            where.setdefault(s, []).append(i)
    seen = set()
    for ids in where.values():
        for k, b in enumerate(ids):
            for a in ids[:k]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                x, y = bags[a], bags[b]
                both = sum((x & y).values())
                if both >= threshold * (sum(x.values()) + sum(y.values()) - both):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in bags}


def test_tables(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r["class_id"] for r in neardup.op5_near_duplicates(spark, sf).collect()}
    assert got == classes(rows)


def test_groups_and_edges(spark):
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = prose(300, g)
        rows += [(1000 * g + k, vary(base, rng.choice([0, 1, 3, 5, 9, 14]), rng)) for k in range(25)]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "two words"), (9005, "two words"), (9006, "two  words "), (None, prose(300, 0)), (9007, "a b c d"), (9007, "a b c d"), (9008, "same word " * 4000), (9009, "same word " * 4001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nd_id", __import__("pyspark").sql.functions.lit("clash"))
    out = neardup.with_classes(docs).collect()
    assert len(out) == len(rows)
    want = classes(rows)
    assert all(r["class_id"] == want[r["doc_id"]] for r in out if r["doc_id"] is not None)
    assert [r["class_id"] for r in out if r["doc_id"] is None] == [None]


def test_empty(spark, edge_dir):
    assert neardup.op5_near_duplicates(spark, f"{edge_dir}/none").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(50)]
    got = {r[0]: r[1] for r in neardup.components(spark.createDataFrame(edges, "nd_low long, nd_high long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("shared", [20, 60, 95])
def test_signatures_estimate_similarity(shared):
    rng = np.random.default_rng(shared)
    k, n = 512, 100
    x = rng.integers(1, 2**62, 2 * n - shared).astype(np.uint64)
    regions, owner = np.r_[x[:n], x[n - shared :]], np.r_[np.zeros(n, int), np.ones(n, int)]
    sig = neardup.dart_signatures(regions, owner, 2, k)
    assert abs((sig[0] == sig[1]).mean() - shared / (2 * n - shared)) < 0.08


def test_weights_count_as_regions():
    h = np.array([5, 5, 5, 9], np.uint64)
    regions, owner = shingles.unit_regions(h, np.zeros(4, int))
    assert len(set(regions.tolist())) == 4
    again, _ = shingles.unit_regions(np.array([5, 5], np.uint64), np.zeros(2, int))
    assert set(again.tolist()) < set(regions.tolist())


def test_word_hashes_follow_the_contract_words():
    import pyarrow as pa

    texts = ["a b\tc", "", "b  a\x0bé\x0c", "ab", "a b c"]
    words, text = shingles.word_hashes(*shingles.text_bytes(pa.array(texts)))
    want = [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    assert text.tolist() == [i for i, _ in want]
    name = {}
    assert all(name.setdefault(w, h) == h for (_, w), h in zip(want, words.tolist()))
    assert len(set(name.values())) == len(name)


def test_pair_meets_in_a_later_bucket_than_its_first(spark):
    """``y`` is settled in the first bucket it shares with ``l``, by the class of a lead that ``l`` isn't like."""
    rng, bits = random.Random(11), np.random.default_rng(11)
    base, y, l = prose(300, 1), 1000, 1003
    texts = {1: vary(base, 6, rng), y: base, l: vary(base, 6, rng)} | {i: prose(40, i) for i in [*range(2, 200), 501, 502, 503]}
    rows = list(texts.items())
    want = classes(rows)
    assert want[y] == want[l] == 1
    keys = {i: [1000 * i + b for b in range(24)] for i in texts}
    signs = {i: bits.integers(-(2**31), 2**31, 96).tolist() for i in texts}
    for i in [1, y, l, *range(2, 200)]:
        keys[i][0] = 1
    for i in [501, 502, 503, y, l]:
        keys[i][1] = 2
    signs[l][:80] = signs[y][:80]
    signed = [(i, i, i, len(t.split()), keys[i], signs[i]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = spark.createDataFrame(signed, "nd_id long, nd_a long, nd_b long, nd_words long, nd_bands array<long>, nd_sign array<int>")
    second = signed.filter("nd_bands[1] = 2").selectExpr("min_by(nd_id, xxhash64(nd_id))").first()[0]
    assert second not in (y, l)
    assert {tuple(r) for r in neardup.links(docs, signed).collect()} == {(1, y), (y, l)}


def test_members_meet_settled_members(spark, monkeypatch):
    """Copies of a text that are like it only, while other copies lead: each link is needed. In several blocks too."""
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng, base = random.Random(5), prose(300, 1)
    rows = [(k, vary(base, 6, rng)) for k in range(120)] + [(10**6, base)]
    want = classes(rows)
    assert set(want.values()) == {0}
    got = {r[0]: r[1] for r in neardup.with_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want
