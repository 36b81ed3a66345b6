"""Secret scans with corpus-wide ownership frequency (built-in expressions only).

Spans come from patterns. The texts between the matches of a pattern and the matches
themselves alternate, so running sums of their lengths give every span's place in code
points. Each candidate value is hashed, and the corpus is asked how many distinct
repositories (sources) and owners (source and language) hold it: a value spread over
many repositories or owners is a copied example, one that stays with few looks live.

Distinct counting runs in two steps (hash with repository and owner, then hash), each
with partial aggregation, so a value that sits in a third of all documents costs one
row a task. Only hashes are shuffled, never the values.

Defined results: a null or empty text has no spans, counts of zero and the digest of
the empty string; repeated rows and null ids are reported each, with the same counts for
the same values; a null source or language is one of its own; ties in place are ordered
by kind; columns named s_base, s_added and s_all are replaced and others pass through;
texts of any length are scanned whole, in time linear in their length; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import let, stored, table, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Kind -> (pattern, least length of the whole match); the order is that of the report.
#: Runs of a class are maximal, so for access and hex the least length can stand in the
#: pattern; assign must match first and be dropped after, as a failing match uses up text.
BASE = {
    "assign": (ASSIGN, 0),
    "access": (r"AKIA[A-Z0-9]{12,}", 16),
    "hex": (r"[0-9a-f]{32,}", 32),
}
#: Kinds that the method adds.
ADDED = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "hub": (r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 28),
}
LEAST_VALUE = 8
#: A value in this many repositories, or with this many owners, is a copied example.
EXAMPLE_REPOS, EXAMPLE_OWNERS = 3, 4
#: Matches of a text whose places are summed up together; places of chunks are summed up after.
CHUNK = 256


def _spans(t: Column, kind: str, order: int, pattern: str) -> Column:
    """Spans of one pattern: array of (start, rank, end, kind, value), code points, end exclusive."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    between = F.split(t, pattern, -1)
    pieces = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")

    def placed(chunk: Column, at: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["m"])
            span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc["out"])

    # a list is copied when it grows: chunks keep a text of very many matches linear
    def by_chunk(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
        starts = F.aggregate(
            chunks,
            F.array(F.lit(0)),
            lambda acc, chunk: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"])))),
        )
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), placed))

    ends = let(pieces, by_chunk)
    if kind == "assign":
        value = lambda s: F.regexp_extract(s["value"], pattern, 2)
        ends = F.transform(F.filter(ends, lambda s: F.length(value(s)) >= LEAST_VALUE), lambda s: s.withField("value", value(s)))
    return F.when(t.rlike(pattern), ends).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds s_base and s_all, arrays of spans by start, then kind. An added kind that lies in a base span is no new finding."""
    t = text_or_empty(text)
    own = [c for c in docs.columns if c not in ("s_base", "s_added", "s_all")]
    base = [_spans(t, kind, i, p) for i, (kind, (p, _)) in enumerate(BASE.items())]
    added = [_spans(t, kind, len(BASE) + i, p) for i, (kind, (p, _)) in enumerate(ADDED.items())]
    out = docs.select(*own, F.array_sort(F.concat(*base)).alias("s_base"), F.concat(*added).alias("s_added"))
    inside = lambda s: F.exists("s_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return out.select(*own, "s_base", F.array_sort(F.concat("s_base", F.filter("s_added", lambda s: ~inside(s)))).alias("s_all"))


def value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def ownership(spanned: DataFrame, repo: str = "source", owner: Column | None = None) -> DataFrame:
    """Candidate hash -> s_repos, s_owners, s_docs: distinct repositories and owners, and spans in all."""
    owner = F.col(repo) if owner is None else owner
    null_safe = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    found = spanned.select(null_safe(F.col(repo)).alias("s_repo"), null_safe(owner).alias("s_owner"), F.explode(F.array_distinct(F.transform("s_all", lambda s: value_hash(s["value"])))).alias("s_hash"))
    pairs = found.groupBy("s_hash", "s_repo", "s_owner").agg(F.count("*").alias("n"))
    repos = pairs.groupBy("s_hash", "s_repo").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    return repos.groupBy("s_hash").agg(F.count("*").alias("s_repos"), F.sum("owners").alias("s_owners"), F.sum("n").alias("s_docs"))


def is_live(repos: str = "s_repos", owners: str = "s_owners", example_repos: int = EXAMPLE_REPOS, example_owners: int = EXAMPLE_OWNERS) -> Column:
    """Owner-specific: in few repositories and with few owners."""
    return (F.col(repos) < example_repos) & (F.col(owners) < example_owners)


def classify(spanned: DataFrame, id_cols: list[str], repo: str = "source", owner: Column | None = None, example_repos: int = EXAMPLE_REPOS, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row a span: id columns, kind, start, end, hash, its ownership and s_live (owner-specific)."""
    spans = spanned.select(*id_cols, F.explode("s_all").alias("s")).select(*id_cols, "s.kind", "s.start", "s.end", value_hash(F.col("s.value")).alias("s_hash"))
    return spans.join(ownership(spanned, repo, owner), "s_hash").withColumn("s_live", is_live("s_repos", "s_owners", example_repos, example_owners))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # spans are few and small; they are read by the ownership count, its join and the report
    spanned = stored(with_spans(docs).drop("text"))
    # what is said of a row hangs on its values alone: lists of values are joined, so ids may repeat or be null
    values = F.transform("s_all", lambda s: value_hash(s["value"]))
    found = spanned.filter(F.size("s_all") > 0)
    lists = found.select(F.sha2(F.array_join(values, ","), 256).alias("s_list"), values.alias("s_hashes")).groupBy("s_list").agg(F.first("s_hashes").alias("s_hashes"))
    owned = lists.select("s_list", F.explode("s_hashes").alias("s_hash")).join(ownership(found, "source", F.concat_ws("/", "source", "lang")), "s_hash")
    shares = owned.groupBy("s_list").agg(
        F.count_if(is_live()).alias("n_live"), F.count_if(~is_live()).alias("n_example"), F.max("s_repos").alias("most_repos"), F.max("s_owners").alias("most_owners")
    )
    label = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s_base", lambda s: s["kind"] == kind)).cast("long")
    # rows without spans have nothing to look up, and would all meet in one task of the join
    told = found.withColumn("s_list", F.sha2(F.array_join(values, ","), 256)).join(shares, "s_list", "left").drop("s_list")
    both = told.unionByName(spanned.filter(F.size("s_all") == 0), allowMissingColumns=True)
    return both.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(label("s_base"), 256).alias("base_sha256"),
        label("s_all").alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("most_repos", F.lit(0)).cast("long").alias("most_repos"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
    )
