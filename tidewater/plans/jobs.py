"""Composite jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import attributions, bots, clean, extract, features, funnel, models, profile, report, sessions
from tidewater.session import stored
from tidewater.sources import io
from tidewater.streaming import streams


@dataclass
class EltConfig:
    """Parameters of the event ELT job."""

    dedup_keys: list[str] = field(default_factory=lambda: ["user_id", "item_id", "behavior_type", "timestamp"])
    timeout: int = 1800
    bucket_seconds: int = 3600
    block_seconds: int = 14 * 86400
    threshold: int = 100
    min_hours: int = 1
    high: int = 500
    medium: int = 300
    tiebreak: list[str] = field(default_factory=list)


def suspects(events: DataFrame, c: EltConfig) -> DataFrame:
    return bots.bots_combined(bots.user_activity(bots.hourly_activity(events, seconds=c.bucket_seconds)), c.threshold, c.min_hours, c.high, c.medium)


def _dealt(events: DataFrame, c: EltConfig) -> DataFrame:
    """Unique events, dealt once by user and block of time and sorted once; what follows uses that.

    Blocks bound what one task gets of a user. They are whole buckets of the activity counts.
    """
    spread = sessions.in_blocks(events, "user_id", "timestamp", -(-c.block_seconds // c.bucket_seconds) * c.bucket_seconds)
    block = ["_user", "_block"]
    if not {"user_id", "timestamp"} <= set(c.dedup_keys):
        return clean.dedup(spread, c.dedup_keys, c.tiebreak or None).repartition(*block)
    others = [k for k in c.dedup_keys if k not in ("user_id", "timestamp")]
    # in this order the sort also serves the sessions
    return clean.dedup(spread.repartition(*block), [*block, "timestamp", *others], c.tiebreak or None)


def _kept_blocks(dealt: DataFrame, c: EltConfig, ends: list[Column] = ()) -> DataFrame:
    """(_user, _block, ...) of users who aren't suspects, a row each, with the aggregates ``ends`` of the block.

    Buckets are counted where the events are; only rows of blocks are dealt by user, and
    what holds for the whole user is told by a window over them.
    """
    names = ["_user", "_block"]
    buckets = dealt.groupBy(*names, F.floor(F.col("timestamp") / c.bucket_seconds).alias("bucket")).agg(F.count("*").alias("n"), *ends)
    folded = [f(x).alias(x) for x, f in (("_first", F.min), ("_last", F.max), ("_inner", F.max)) if x in buckets.columns]
    blocks = buckets.groupBy(*names).agg(F.max("n").alias("n"), F.count("*").alias("hours"), *folded)
    user = Window.partitionBy("_user")
    blocks = blocks.withColumn("max_actions_per_hour", F.max("n").over(user)).withColumn("active_hours", F.sum("hours").over(user))
    return blocks.filter(~bots.is_suspect(c.threshold, c.min_hours)).drop("n", "hours", "max_actions_per_hour", "active_hours")


def elt_groups(events: DataFrame, c: EltConfig) -> DataFrame:
    """Deduplicated events of users who aren't suspects, with session_group and _user (the user as a key that is never null).

    Events are dealt by user and block only: once with the columns that decide, and once
    more whole if others are wanted. Suspects and the borders of blocks are found from a row
    for each block of a user, and what is left out is told by those rows as well, so
    neither a bot nor a busy user makes a long task.
    """
    marks = sessions.marked(_dealt(events, c), "timestamp", c.timeout)
    blocks = sessions.with_bases(_kept_blocks(marks, c, sessions.block_ends("timestamp")), c.timeout).select("_user", "_block", "_base")
    return marks.join(blocks, ["_user", "_block"]).select("_user", *events.columns, (F.col("_base") + F.col("_breaks")).alias("session_group"))


def elt_by_user(events: DataFrame, c: EltConfig) -> DataFrame:
    """``elt`` for a table that is stored in buckets by user (``io.write_bucketed``): no event is exchanged.

    A user's events are one task here; ``elt`` splits them.
    """
    unique = clean.dedup(events, c.dedup_keys, c.tiebreak or None)
    kept = clean.exclude_keys(unique, suspects(unique, c).select("user_id"), "user_id")
    return sessions.sessionize(kept, timeout=c.timeout).select(*events.columns, "session_id")


def elt(events: DataFrame, c: EltConfig) -> DataFrame:
    """Deduplicated events of users who aren't suspects, in sessions."""
    id_ = F.concat_ws("_", F.col("user_id").cast("string"), F.col("session_group").cast("string"))
    return elt_groups(events, c).select(*events.columns, id_.alias("session_id"))


def elt_funnel(events: DataFrame, c: EltConfig) -> DataFrame:
    """The job's summary: rows, users, sessions, and the funnel over what is kept; each user is summed up once."""
    users = funnel.behavior_matrix(elt_groups(events, c), ["_user"], extra=[F.count("*").alias("rows_"), F.max("session_group").alias("sessions_")])
    stats = [F.coalesce(F.sum("rows_"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_users"), F.coalesce(F.sum("sessions_"), F.lit(0)).alias("n_sessions")]
    return funnel.funnel(users, extra=stats)


def elt_to(spark: SparkSession, source: str, target: str, c: EltConfig) -> DataFrame:
    """Reads partitioned events, writes the kept ones in sessions, returns the funnel over the written files."""
    io.write_parquet(elt(io.read_partitioned(spark, source), c), target)
    return funnel.funnel(funnel.behavior_matrix(io.read_table(spark, target)))


def export(events: DataFrame, c: EltConfig) -> DataFrame:
    """The shorter job: deduplicate and leave out suspects."""
    dealt = _dealt(events, c)
    return dealt.join(_kept_blocks(dealt, c), ["_user", "_block"], "left_semi").select(*events.columns)


def clean_logs(logs: DataFrame) -> DataFrame:
    """Raw application logs: blank ids out, typos mended, users masked."""
    return clean.mask_sha256(clean.remap(clean.drop_blank(logs, "event_id"), "event_type", clean.EVENT_TYPOS), "user_id", "masked_user_id")


def clean_behavior(events: DataFrame, low: int, high: int, kinds: tuple = ("pv", "cart", "fav", "buy")) -> DataFrame:
    """Complete, distinct, known, in range, with date and hour, and positive ids."""
    kept = clean.keep_allowed(clean.distinct_rows(clean.drop_nulls(events)), "behavior_type", list(kinds))
    return clean.keep_positive(clean.add_time_columns(clean.keep_between(kept, "timestamp", low, high)), ["user_id", "item_id"])


def clean_logs_to(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Raw logs (CSV with a header) to clean Parquet; what that saves."""
    io.write_parquet(clean_logs(io.read_csv(spark, source, multiline=True)), target)
    return io.storage_report(spark, source, target)


def clean_behavior_to(spark: SparkSession, events: DataFrame, target: str, low: int, high: int) -> DataFrame:
    """Clean behaviour to Parquet; the report of what is there."""
    io.write_parquet(clean_behavior(events, low, high), target)
    return profile.cleaning_report(io.read_table(spark, target))


def clean_to_partitions(spark: SparkSession, events: DataFrame, path: str) -> DataFrame:
    io.write_partitioned(clean.keep_valid_events(events), path, ["behavior_type"])
    return io.read_partitioned(spark, path)


def partitions_report(spark: SparkSession, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Behaviour CSV without a header to folders by behaviour; the storage and the layout report."""
    stored = clean_to_partitions(spark, io.read_behavior_csv(spark, source), target)
    return io.storage_report(spark, source, target), io.layout_report(stored, ["behavior_type"])


def score_stream_job(spark: SparkSession, source: str, model: PipelineModel, folder: str, max_files: int = 1, strict: bool = False) -> DataFrame:
    """Scores behaviour CSV as a stream until all that is there is done; tallies of scored rows and dead letters."""
    query = streams.stream_score(streams.stream_behavior(spark, source, max_files), model, f"{folder}/good", f"{folder}/dead", f"{folder}/checkpoint", strict=strict)
    query.awaitTermination()
    return streams.tallies(spark, f"{folder}/good", f"{folder}/dead")


def dashboard(reviews: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's queries over one table; persist it before where it is small."""
    return {
        "sentiment": profile.value_counts(reviews, "sentiment"),
        "by_category": report.sentiment_pivot(reviews, "cat"),
        "words": report.word_counts(reviews, ["review"]),
        "page": report.review_page(reviews, "doc_id", "review")[0],
    }


def enrich_reviews(reviews: DataFrame, key: str, text: str, client, n: int, template: str = "{review_text}", **options) -> DataFrame:
    """A sample of reviews with fields extracted by a client from a prompt and joined back by key."""
    picked = features.sample_n(reviews, n, key)
    asked = picked.select(key, extract.render_prompt(template, text).alias("prompt"))
    replies = extract.validate_reply(extract.extract(asked, "prompt", client, **options), "reply")
    return clean.augment(picked, replies.drop("prompt", "reply"), key)


def enrichment_job(spark: SparkSession, reviews: DataFrame, key: str, text: str, client, n: int, target: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enriched reviews written as CSV and read back, the quality gate over them, and the share that was extracted."""
    io.write_csv(enrich_reviews(reviews, key, text, client, n, **options), target)
    done = io.read_csv(spark, target, multiline=True)
    gate = extract.quality_gate(done, [key, "sentiment", "category"], {"sentiment": list(extract.SENTIMENTS), "category": list(extract.CATEGORIES)})
    return done, gate, done.agg(F.count("*").alias("n"), F.round(F.avg(F.col("format_valid").cast("int")), 6).alias("success"))


def classification_study(reviews: DataFrame, key: str, text: str, dense: list[str], label: str = "label", terms: int = 500, rounds: int = 100, top: int = 15) -> tuple[list[tuple], list[tuple]]:
    """Characters against fields against both, on one split: (arm, accuracy, AUC, points of accuracy over arm A) by
    arm, and the features with the largest parts in the margins of both's test rows."""
    known = reviews.filter(F.col(label).isNotNull()).select(key, F.coalesce(text, F.lit("")).alias(text), F.col(label).cast("double").alias(label), *dense)
    vectors, names = features.tfidf_vectors(known, key, text, terms)
    coded = stored(features.ordinal_encode(vectors.drop(text), dense))
    codes = [f"{c}_code" for c in dense]
    found = models.ablation(coded, {"A": ["text_vector"], "B": codes, "C": ["text_vector", *codes]}, key, label, rounds)
    both = found[-1][3]
    test = models.fuse(features.split_stratified(coded, label, key, 0.2)[1], ["text_vector", *codes])
    parts = attributions.strongest(attributions.attributions(test, both.stages[-1], key), [*names, *dense], top)
    return [(arm, accuracy, auc, (accuracy - found[0][1]) * 100) for arm, accuracy, auc, _ in found], [tuple(r) for r in parts.collect()]  # at most ``top`` rows
