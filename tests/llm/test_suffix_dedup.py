"""Suffix deduplication against every string of 50 bytes in plain Python."""

import hashlib
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests_llm_prose import prose
from tidewater.llm import induced, suffix_dedup


def expected(rows, n=50):
    least, raws = {}, {}
    for i, text in rows:
        raw = raws[i] = (text or "").encode()
        if i is None:
            continue
        for s in {raw[k : k + n] for k in range(len(raw) - n + 1)}:
            least[s] = min(i, least.get(s, i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1 if i is not None else 0):
            if least[raw[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_tables(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert Counter(map(tuple, suffix_dedup.op3_suffix_dedup(spark, sf).collect())) == expected(rows)


def test_made(spark, tmp_path):
    rng = random.Random(2)
    passage = [prose(30, k) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(1, 20), 100 + i)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a = rng.randint(0, 60)
            parts += [p[a : a + rng.choice([30, 49, 50, 51, 80, 500])], prose(rng.randint(0, 9), rng.random())]
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "", "é"]).join(parts)))
    rows += [(5, None), (6, ""), (7, "x" * 400), (8, "x" * 60), (9, "ab" * 200), (10, "ab" * 26), (None, passage[0]), (11, rows[0][1]), (11, rows[0][1]), (10**7, "é" * 40), (10**7 + 1, "é" * 30 + "z")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 sd_doc").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)).collect())) == expected(rows)


def test_empty(spark, edge_dir):
    assert suffix_dedup.op3_suffix_dedup(spark, f"{edge_dir}/none").count() == 0


@pytest.mark.parametrize("memory", [64, 1 << 20])
def test_induced_order(memory):
    rng = np.random.default_rng(7)
    for _ in range(120):
        n = int(rng.integers(1, 150))
        t = rng.integers(0, int(rng.integers(2, 6)), n)
        s = t.tolist()
        order = induced.suffix_order(t, 50, memory)
        assert [s[i : i + 50] for i in order.tolist()] == [s[i : i + 50] for i in sorted(range(n), key=lambda i: s[i:])]
        shared = induced.same_prefix(t, order, 20)
        assert shared.tolist() == [j > 0 and order[j] + 20 <= n and s[order[j] : order[j] + 20] == s[order[j - 1] : order[j - 1] + 20] for j in range(n)]


def test_long_texts(spark, tmp_path):
    """Texts of several parts: repeats across the cuts, also of a part that starts elsewhere in the other text."""
    part = suffix_dedup.PART
    base = "".join(prose(200, 900 + k) for k in range(300))
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefgh ") for _ in range(3 * part))
    rows = [(1, noise), (2, "q" * 77 + noise[: part + 500]), (3, base[:60000] + noise[part - 90 : part + 30]), (4, base[:60000]), (5, noise[part - 49 : part + 1]), (6, noise[part - 48 : part + 1]), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)).collect())) == expected(rows)


@pytest.mark.parametrize("sizes", [[1 << 22], [2000] * 2000])
def test_blocks_take_little_memory(sizes):
    """The arrays over the places of a text are those of a part, however long the text or the batch."""
    rng = random.Random(4)
    texts = [rng.randbytes(n // 2).hex() for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["sd_doc", "sd_text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffix_dedup._pack(6)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6 and peak < 12 * sum(sizes)


def test_spans_are_merged_by_row():
    row, begin, end = (np.array(x) for x in zip((1, 5, 9), (0, 2, 6), (0, 0, 3), (1, 9, 12), (2, 12, 20), (0, 6, 7), (0, 9, 10), (1, 6, 7)))
    assert [x.tolist() for x in suffix_dedup._merged(row, begin, end)] == [[0, 0, 1, 2], [0, 9, 5, 12], [7, 10, 12, 20]]
