"""Decontamination against windows in plain Python and against SQL."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest

from tests_llm_prose import prose
from tidewater.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    wins = {}
    for i, text in items:
        w = words(text)
        for s in range(len(w) - min(13, len(w)) + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + 13]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    a, b, c = prose(40, 1), prose(20, 2), "Tiny ITEM words"
    items = [(1, a), (10, b), (2, b), (3, c), (4, ""), (5, None), (6, "word"), (None, prose(15, 7))]
    docs = [
        (1, f"{prose(100, 11)} {a} {prose(30, 12)}"),
        (2, f"{prose(100, 13)} {' '.join(a.split()[5:18])}"),
        (3, f"{prose(100, 13)} {' '.join(a.split()[5:17])}"),
        (4, f"{b.upper()} x {b} tiny, item; words!"),
        (5, f"{' '.join(b.split()[:13])} {' '.join(b.split()[1:14])} {prose(900, 5)}"),
        (6, None),
        (7, ""),
        (8, "word " * 60),
        (8, "word " * 60),
        (8, "another text with a word"),
        (None, a),
        (9, prose(15, 7)),
        (10, f"{prose(3000, 21)} tiny item words"),
        (11, "É" + b + " é"),
    ]
    d = str(tmp_path_factory.mktemp("dc"))
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' dc_a", "1 dc_term").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_made(spark, made):
    d, docs, items = made
    assert Counter(map(tuple, dc.op4_decontamination(spark, d).collect())) == expected(docs, items)


@pytest.mark.parametrize("bits", [1 << 15, dc.BITS])
def test_without_broadcasts_and_with_terms_that_the_bitmap_lets_through(spark, made, monkeypatch, bits):
    d, docs, items = made
    monkeypatch.setattr(dc, "BITS", bits)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert Counter(map(tuple, dc.op4_decontamination(spark, d).collect())) == expected(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dc_")]


def test_postings_are_not_moved_again(spark, made):
    """The join that checks candidates exchanges their side only."""
    d, docs, items = made
    terms, _ = dc.windows(spark.createDataFrame(items, "item_id long, text string"))
    index = dc.positional_index(spark.createDataFrame(docs, "doc_id long, text string"), terms.select("dc_term").distinct())
    other = spark.range(10).selectExpr("id as dc_a", "cast(id as int) as dc_b", "string(id) as dc_term")
    plan = other.join(index.hint("merge"), dc.POSTING)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    dc.drop_index(index)


def test_very_long_text(spark):
    items = spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{prose(300_000, 2)} {prose(20, 1)}")], "doc_id long, text string")
    found, sizes = dc.hits(docs, items)
    assert found.first()["dc_hit"] == 20 and sizes.first()["dc_words"] == 300_020


def test_tables(spark, sf):
    read = lambda n: duckdb.sql(f"select {n[1]}, text from '{sf}/{n[0]}.parquet'").fetchall()
    got = Counter(map(tuple, dc.op4_decontamination(spark, sf).collect()))
    assert got == expected(read(("documents", "doc_id")), read(("benchmark", "item_id")))
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    assert got == Counter(con.sql(dc.OP4_SQL).fetchall())


def test_empty_tables(spark, made, edge_dir, tmp_path):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    found, sizes = dc.hits(docs, items)
    assert found.count() == 0 and [r["dc_words"] for r in sizes.collect()] == [2]
    d = str(tmp_path)
    os.symlink(f"{edge_dir}/none/documents.parquet", f"{d}/documents.parquet")
    os.symlink(f"{made[0]}/benchmark.parquet", f"{d}/benchmark.parquet")
    assert dc.op4_decontamination(spark, d).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma"), (2, "alpha so beta gamma"), (3, "gamma alpha beta"), (4, "alpha beta")], "doc_id long, text string")
    terms, _ = dc.windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = dc.positional_index(docs, terms.select("dc_term").distinct())
    ids = {(r["dc_a"], r["dc_b"]): r["doc_id"] for r in dc.keyed(docs, "doc_id", "text").collect()}
    found = lambda slop: {ids[r["dc_a"], r["dc_b"]] for r in dc.proximity_matches(index, terms, slop).collect()}
    assert found(0) == {1} and found(1) == {1, 2} and found(3) == {1, 2, 3}
