"""Operators that judge each document by itself, against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing, quality, secrets, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(d):
    return duckdb.sql(f"select doc_id, text, source, lang from '{d}/documents.parquet'").fetchall() if d.startswith("/root") else None


@pytest.fixture(params=["sf", "edge"])
def data(request, sf, edge_dir, edge_rows):
    if request.param == "sf":
        return sf, documents(sf)
    return f"{edge_dir}/full", [(r[0], r[1], r[3], r[2]) for r in edge_rows]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_token_counts(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    d, rows = data
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    want = []
    for i, text, _, _ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 1024))
    same(tokens.op1_token_counts(spark, d).collect(), want)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (40, 8), (500, 64)])
def test_spliced_counts_are_exact(chunk, overlap, edge_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    encode = lambda s: t.encode(s, add_special_tokens=False)
    texts = [r[1] for r in edge_rows if r[1]] + ["a" * 3000, " " * 700 + "x", "ab <|endoftext|>" * 90, "1" * 50 + " \n" * 400, "日本語テキスト" * 80 + " 'll don't we're " * 40]
    for text in texts:
        assert tokens.spliced_count(encode, text, chunk, overlap) == len(encode(text).ids)


def features(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, data):
    d, rows = data
    got = quality.op9_quality_rules(spark, d).collect()
    same([r[:7] for r in got], [(i, *features(t)) for i, t, _, _ in rows])
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in quality.op9_quality_rules(spark, d).collect()}
    labels = [x for x in duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall() if x[0] in kept]
    texts = {x[0]: x[1] for x in documents(d)}
    clean = [i for i, q in labels if q and not features(texts[i])[-1]]
    assert sum(kept[i] for i in clean) >= 0.98 * len(clean)
    junk = [i for i, q in labels if not q]
    assert sum(not kept[i] for i in junk) >= 0.95 * len(junk)


def test_em_recovers_accuracies():
    import itertools
    import random

    rng = random.Random(5)
    rates = [(0.9, 0.2), (0.8, 0.1), (0.7, 0.3), (0.95, 0.4)]
    seen = Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        seen[tuple(1 if rng.random() < (g if good else b) else -1 for g, b in rates)] += 1
    model = quality.estimate(sorted(seen.items()))
    assert abs(model["prior"] - 0.7) < 0.06
    for (g, b), (tg, tb) in zip(rates, model["rules"]):
        assert abs(tg[1] - g) < 0.08 and abs(tb[1] - b) < 0.12
    assert all(0 <= quality.posterior(model, v) <= 1 for v in itertools.product((-1, 0, 1), repeat=4))


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def base_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_secret_spans(spark, data):
    d, rows = data
    want = []
    for i, text, _, _ in rows:
        spans = base_spans(text)
        n = Counter(s[3] for s in spans)
        label = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(label.encode()).hexdigest()))
    got = secrets.op7_secret_scan(spark, d).collect()
    same([r[:5] for r in got], want)
    for r in got:
        kept = [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]


def test_ownership_tells_examples_from_live_values(spark):
    rows = [(i, f"repo{i % 5}", "en", "token = EXAMPLEVALUE123") for i in range(20)] + [(100, "repo1", "en", "token = live0live0live0"), (101, "repo1", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = secrets.classify(secrets.with_spans(docs), ["doc_id"]).collect()
    assert {r["doc_id"]: r["s_live"] for r in got} == {**{i: False for i in range(20)}, 100: True}
    assert {r["s_repos"] for r in got if not r["s_live"]} == {5}


def test_owners_of_one_repository_tell_examples_too(spark):
    rows = [(i, "hot", f"l{i % 4}", "token = EXAMPLEVALUE123") for i in range(8)] + [(9, "hot", "l0", "secret: live0live0live0")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = secrets.classify(secrets.with_spans(docs), ["doc_id"], "source", F.concat_ws("/", "source", "lang")).collect()
    assert {r["doc_id"]: (r["s_live"], r["s_repos"], r["s_owners"]) for r in got} == {**{i: (False, 1, 4) for i in range(8)}, 9: (True, 1, 1)}


def test_secrets_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a", "en", "token = live0live0live0"), (1, "a", "en", "token = live0live0live0"), (None, "b", "en", "token = other0other0x"), (1, "b", "en", "nothing"), (2, None, None, "x secret=hunter2hunter2 token=hunter2hunter2")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["n_assign"], r["n_live"], r["n_example"]) for r in secrets.op7_secret_scan(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1, 0), (1, 0, 0, 0), (1, 1, 1, 0), (1, 1, 1, 0), (2, 2, 2, 0)]


def test_secrets_of_hostile_and_very_long_texts(spark):
    n = 350_000
    texts = ["-----BEGIN " + "AB " * n, "eyJ" * n, "eyJaaaaaaaaa." * (n // 4), "token" + " " * 3 * n, "AKIA " * (n // 2), "a" * 3 * n, "ghp_" * n, "xoxb-" * n, "secret=abcdefgh " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).withColumn("s_base", F.lit("clash"))
    got = {r["doc_id"]: r["spans"] for r in secrets.with_spans(docs).selectExpr("doc_id", "transform(s_all, s -> concat_ws(':', s.kind, s.start, s.end)) spans").collect()}
    for i, t in enumerate(texts):
        kept = [s for s in got[i] if s.split(":")[0] in ("assign", "access", "hex")]
        assert kept == [f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)]


def test_mix(spark, data):
    d, rows = data
    got = mixing.op10_systematic_mix(spark, d).collect()
    size = Counter()
    source_of = {}
    for _, text, source, _ in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = 1.5 * sum(size.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        rest -= sum(2 * size[s] for s in over)
        open_ -= over
    assert len(got) == len(rows)
    want = Counter((i, len(WORD.findall(t or "")), size[s], round(target[s], 6)) for i, t, s, _ in rows)
    assert Counter((r[0], r[1], r[2], round(r[3], 6)) for r in got) == want
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    taken, largest = Counter(), Counter()
    for r in got:
        key = (r["source_size"], round(r["target"], 6))
        taken[key] += r["taken"]
        largest[key] = max(largest[key], r["size"])
    assert all(abs(taken[k] - k[1]) <= 2 * largest[k] * sum(1 for s in names if (size[s], round(target[s], 6)) == k) for k in taken)
    again = mixing.op10_systematic_mix(spark, d).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    same(mixing.op10_systematic_mix(spark, sf).collect(), con.sql(mixing.OP10_SQL).fetchall())


def test_mix_repeats_documents(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/full/documents.parquet").withColumn("mix_copies", __import__("pyspark").sql.functions.lit("clash"))
    copies = mixing.with_copies(docs).collect()
    assert sum(r["mix_copies"] for r in copies) == mixing.mixed(docs).count()


@pytest.mark.parametrize("query", [tokens.op1_token_counts, secrets.op7_secret_scan, quality.op9_quality_rules, mixing.op10_systematic_mix])
def test_empty_table(spark, edge_dir, query):
    assert query(spark, f"{edge_dir}/none").count() == 0


def test_query_over_texts_that_are_spliced(spark, tmp_path):
    """The registered query on texts longer than a chunk, against the library on whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    words = "plain words don't é ß 日本語 x1y2  \n\t 12345 ... <|endoftext|> and-so-on ".split(" ")
    texts = [" ".join(words[(i * i + k) % len(words)] for i in range(9000)) for k in range(3)] + ["a" * (tokens.HUGE + 5000), " " * 40000 + "end", "日" * 30000]
    assert all(len(t) > tokens.HUGE for t in texts)
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    whole.no_truncation()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.op1_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}


def test_mix_of_very_long_texts_and_finer_blocks(spark, monkeypatch):
    rows = [(i, "w " * (i % 3 + 1), "s") for i in range(300)] + [(1000, "long " * 400_000, "s"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["mix_copies"] <= 2 for r in got)
    assert {r["mix_doc_size"] for r in got} == {0, 1, 2, 3, 400_000}


def test_quality_of_long_texts_and_clashing_names(spark):
    rows = [(1, "word " * 300_000), (2, " ".join(f"w{i}" for i in range(100_000))), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("q_n", F.lit("clash"))
    got = {r["doc_id"]: (r["q_n"], r["q_failed"]) for r in quality.judged(docs).collect()}
    assert got == {1: (300_000, True), 2: (100_000, False), 3: (0, True)}
