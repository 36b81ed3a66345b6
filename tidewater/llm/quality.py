"""Quality rules by weak supervision (built-in expressions only).

Each rule looks at a document and votes good (1) or bad (-1), or abstains (0). No rule
has the last word: expectation-maximisation estimates, from the agreement of the rules
over all documents, how often each rule votes either way on good and on bad documents,
and the posterior probability of being good decides. What EM needs is the number of
documents with each combination of votes, one partial aggregate with at most
3 ** rules rows however large the corpus is; the rounds run over that bounded table.

Defined results: a null or empty text has no words, zero for every count and fails the
base rule; every row is judged for itself, so ties, repeated rows and null ids get equal
results for equal texts; texts of any length are judged whole; columns named q_* are
replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, stored, table, text_or_empty

SHINGLE = 8
BLANKS = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Rule name -> SQL for a bad vote and for a good vote; neither: the rule abstains.
RULES = {
    "length": ("q_n < 20", "q_n >= 50"),
    "repeats": ("100 * q_repeat > 30 * q_n", "q_repeat = 0"),
    "symbols": ("10 * q_symbols > 3 * q_n", "50 * q_symbols <= q_n"),
    "word_length": ("q_n > 0 and (q_chars < 3 * q_n or q_chars > 10 * q_n)", "q_chars >= 4 * q_n and q_chars <= 7 * q_n"),
    "lines": ("10 * q_dup_lines > 3 * q_lines", "q_dup_lines = 0"),
    "letters": ("5 * q_letters < 3 * q_length", "4 * q_letters >= 3 * q_length"),
    "case": ("10 * q_upper > 3 * q_letters", "10 * q_upper <= q_letters"),
}


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with q_n (words), q_chars, q_symbols, q_lines, q_dup_lines, q_repeat, q_length, q_letters, q_upper.

    q_repeat counts the words inside 8-word windows that occur twice or more in the
    text. Words are hashed to 64 bits, and windows of 2, 4 and 8 words are hashed from
    two halves; only texts in which a window hash recurs are sorted. Each step is a
    column of its own, so that none is computed twice.
    """
    own = [c for c in docs.columns if not c.startswith("q_")]
    t = text_or_empty(text)

    def paired(c: str, step: int) -> Column:
        n = F.greatest(F.size(c) - step, F.lit(0))
        return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    s, m = F.col("q_sorted"), F.size("q_sorted")
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    at = F.filter(F.sequence(F.lit(0), m - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    covered = F.aggregate(
        F.array_sort(F.transform(at, lambda i: F.get(s, i)["i"])),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["total"] + x + SHINGLE - F.greatest(x, acc["end"])).alias("total"), (x + SHINGLE).alias("end")),
        lambda acc: acc["total"],
    )
    return (
        docs.select(*own, t.alias("q_text"))
        .withColumn("q_words", F.regexp_extract_all("q_text", F.lit(WORD), F.lit(0)))
        .withColumn("q_line_list", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(BLANKS)))
        .withColumn("q_1", F.transform("q_words", lambda w: F.xxhash64(w)))
        .withColumn("q_2", paired("q_1", 1))
        .withColumn("q_4", paired("q_2", 2))
        .withColumn("q_8", paired("q_4", 4))
        .withColumn(
            "q_sorted",
            F.when(
                F.size(F.array_distinct("q_8")) < F.size("q_8"),
                F.sort_array(F.transform("q_8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .select(
            *own,
            F.size("q_words").cast("long").alias("q_n"),
            F.length(F.array_join("q_words", "")).cast("long").alias("q_chars"),
            F.regexp_count("q_text", F.lit(SYMBOLS)).cast("long").alias("q_symbols"),
            F.size("q_line_list").cast("long").alias("q_lines"),
            (F.size("q_line_list") - F.size(F.array_distinct("q_line_list"))).cast("long").alias("q_dup_lines"),
            F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long").alias("q_repeat"),
            F.length("q_text").cast("long").alias("q_length"),
            F.length(F.regexp_replace("q_text", r"\P{L}+", "")).cast("long").alias("q_letters"),
            F.length(F.regexp_replace("q_text", r"\P{Lu}+", "")).cast("long").alias("q_upper"),
        )
    )


def base_failed() -> Column:
    return F.expr("q_n < 20 or 100 * q_repeat > 30 * q_n")


def votes(rules: dict[str, tuple[str, str]] = RULES) -> dict[str, Column]:
    return {name: F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for name, (bad, good) in rules.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, smooth: float = 1.0) -> dict:
    """EM over vote patterns: prior of good and, per rule, P(vote | good) and P(vote | bad).

    It starts from the majority of votes (a tie counts for good), and a rule's estimate
    always leaves a bad vote at least as likely on bad documents as on good ones, so
    the two classes can't change places. ``smooth`` is added to every count.
    """
    m = len(patterns[0][0]) if patterns else 0
    weight = [min(0.99, max(0.01, 0.5 + 0.2 * sum(v) + 0.05)) for v, _ in patterns]
    total = sum(n for _, n in patterns)
    model = {"prior": 0.5, "rules": [({-1: 1 / 3, 0: 1 / 3, 1: 1 / 3},) * 2] * m}
    for _ in range(rounds if total else 0):
        good = sum(w * n for w, (_, n) in zip(weight, patterns))
        rules = []
        for j in range(m):
            tables = []
            for side in (1, 0):
                counts = {v: smooth for v in (-1, 0, 1)}
                for w, (v, n) in zip(weight, patterns):
                    counts[v[j]] += n * (w if side else 1 - w)
                all_ = sum(counts.values())
                tables.append({v: c / all_ for v, c in counts.items()})
            for v in (-1, 1):
                if (tables[0][v] - tables[1][v]) * v < 0:
                    tables[0][v] = tables[1][v] = (tables[0][v] + tables[1][v]) / 2
            rules.append(tuple(tables))
        model = {"prior": min(0.999, max(0.001, good / total)), "rules": rules}
        weight = [posterior(model, v) for v, _ in patterns]
    return model


def posterior(model: dict, vote: tuple[int, ...]) -> float:
    score = math.log(model["prior"] / (1 - model["prior"])) + sum(math.log(g[v] / b[v]) for v, (g, b) in zip(vote, model["rules"]))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, score))))


def with_posterior(featured: DataFrame, rules: dict[str, tuple[str, str]] = RULES, rounds: int = 50) -> DataFrame:
    """Adds q_votes (array) and q_good, the posterior probability of being good."""
    cast = votes(rules)
    voted = featured.withColumn("q_votes", F.array(*cast.values()))
    # at most 3 ** len(rules) rows, whatever the corpus
    counted = voted.groupBy("q_votes").count().collect()
    model = estimate(sorted((tuple(r["q_votes"]), r["count"]) for r in counted), rounds)
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, (good, bad) in enumerate(model["rules"]):
        v = F.get("q_votes", F.lit(j))
        score = score + F.when(v == -1, math.log(good[-1] / bad[-1])).when(v == 1, math.log(good[1] / bad[1])).otherwise(math.log(good[0] / bad[0]))
    return voted.withColumn("q_good", 1 / (1 + F.exp(-score)))


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, votes, q_good and q_kept: not failed by the base rule and probably good.

    The features are stored: EM and the verdict read them, and a filter on the verdict
    must not be pushed below them, where it would repeat their expressions.
    """
    scored = with_posterior(stored(with_features(docs, text)))
    return scored.withColumn("q_failed", base_failed()).withColumn("q_kept", ~F.col("q_failed") & (F.col("q_good") >= threshold))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the counts are read twice, by EM and by the verdict: texts are scanned once
    featured = stored(with_features(docs).drop("text"))
    scored = with_posterior(featured)
    return scored.select(
        "doc_id",
        F.col("q_n").alias("n_words"),
        F.col("q_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"),
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("q_good") >= 0.5)).alias("kept"),
        F.round("q_good", 6).alias("p_good"),
    )
