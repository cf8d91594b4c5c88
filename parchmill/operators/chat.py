"""Conversations, messages, retrieved chunks and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .profile import running_total

STALE_MINUTES = 5


def latest(df: DataFrame, key: str, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the last by `by`; equal ones by the given columns, so that the choice doesn't depend on the order of rows.

    columns: those that are wanted, besides key and by; the others are neither read nor shuffled.
    """
    wanted = [c for c in (df.columns if columns is None else columns) if c not in (key, by)]
    plain = [c for c in wanted if df.schema[c].dataType.typeName() not in ("map", "variant")]
    best = df.groupBy(key).agg(F.max(F.struct(by, *plain)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c == by or c in plain])


def owned(conversations: DataFrame, user: str) -> DataFrame:
    return conversations.filter((F.col("user_id") == user) & ~F.col("is_deleted"))


def message_counts(conversations: DataFrame, messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Conversations with their number of messages, 0 included."""
    n = messages.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"))
    return conversations.join(n, key, "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def stale_empty(conversations: DataFrame, messages: DataFrame, now: Column, key: str = "conversation_id", minutes: int = STALE_MINUTES) -> DataFrame:
    """Conversations without messages that were made more than some minutes ago."""
    return conversations.join(messages.select(key).distinct(), key, "left_anti").filter(F.col("created_at") < now - F.make_interval(mins=F.lit(minutes)))


def soft_deleted(conversations: DataFrame, gone: DataFrame, reason: str, now: Column, key: str = "conversation_id") -> DataFrame:
    """is_deleted set, and the reason and time noted, for the keys of gone; the rest unchanged."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False))
    return (
        conversations.join(marks, key, "left").withColumn("is_deleted", F.col("is_deleted") | hit).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
        .withColumn("deleted_reason", F.when(hit, F.lit(reason))).drop("_gone")
    )


def renamed(conversations: DataFrame, titles: DataFrame, now: Column, key: str = "conversation_id") -> DataFrame:
    """New titles (key, title) put in, at most 255 characters, blank ones ignored."""
    t = titles.filter(F.trim("title") != "").select(key, F.substring("title", 1, 255).alias("_t")).dropDuplicates([key])
    return conversations.join(t, key, "left").withColumn("title", F.coalesce("_t", "title")).withColumn("updated_at", F.when(F.col("_t").isNotNull(), now).otherwise(F.col("updated_at"))).drop("_t")


def created(ids: DataFrame, user: str, now: Column, title: str = "Nouvelle Conversation", key: str = "conversation_id") -> DataFrame:
    return ids.select(F.col(key), F.lit(user).alias("user_id"), F.lit(title).alias("title"), now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("is_deleted"))


def first_messages(messages: DataFrame, role: str, key: str = "conversation_id") -> DataFrame:
    """First message of a role in each conversation, by time and id."""
    m = messages.filter((F.lower(F.trim("role")) == role) & F.col("created_at").isNotNull())
    return m.groupBy(key).agg(F.min(F.struct("created_at", "message_id", "content")).alias("_m")).select(key, F.col("_m.message_id").alias("message_id"), F.col("_m.content").alias("content"))


def nested_messages(messages: DataFrame, retrieved: DataFrame, key: str = "conversation_id", most: int = 1_000) -> DataFrame:
    """Conversations with their messages, each with its retrieved chunks, as nested arrays in order of time and rank.

    An array holds at most `most` messages: a longer conversation comes as several rows, numbered by part from 0 in the order of its messages.
    (created_at, message_id) must tell any two messages of a conversation apart.
    """
    chunks = retrieved.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("rank", "retrieved_id", "titre", "source_file", "score"))).alias("chunks"))
    numbered = running_total(messages.select(key, "created_at", "message_id", "role", "content").withColumn("_1", F.lit(1)), [key], ["created_at", "message_id"], "_1", "_number")
    m = numbered.withColumn("part", F.floor((F.col("_number") - 1) / most).cast("int")).join(chunks, "message_id", "left")
    return m.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("created_at", "message_id", "role", "content", "chunks"))).alias("messages"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20, most: int = 100) -> DataFrame:
    """A page of the ordered rows, from 1."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def search(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Every word of the query in one of the columns, whatever the case."""
    out = df
    for term in query.split():
        any_ = F.lit(False)
        for c in columns:
            any_ = any_ | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
        out = out.filter(any_)
    return out


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def valid_messages(messages: DataFrame, roles: Sequence[str] = ("user", "assistant", "system"), most: int = 2_000) -> DataFrame:
    """error (role, blank, too_long) of each message, null for a valid one: filter for the quarantine."""
    c = F.col("content")
    return messages.withColumn("error", F.when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "role").when(~F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False)), "blank").when((F.col("role") == "user") & (F.length(c) > most), "too_long"))


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """error (rating, nothing) of each row, null for a valid one."""
    nothing = F.col("rating").isNull() & (F.coalesce(F.trim("sentiment"), F.lit("")) == "") & (F.coalesce(F.trim("issue_type"), F.lit("")) == "") & (F.coalesce(F.trim("comment"), F.lit("")) == "")
    return feedback.withColumn("error", F.when(F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), "rating").when(nothing, "nothing"))


def merged_feedback(updates: DataFrame, key: str = "message_id", by: str = "submitted_at", tie: str = "feedback_id") -> DataFrame:
    """One row per message: of each column the last value that isn't null or blank, as partial updates keep what they don't name."""

    def last(c: str) -> Column:
        has = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
        return F.max_by(F.when(has, F.col(c)), F.when(has, F.struct(by, tie))).alias(c)

    return updates.groupBy(key).agg(*[last(c) for c in ("rating", "sentiment", "issue_type", "comment")], F.max(by).alias(by))


def rateable(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Feedback on an assistant's message in a conversation of its own user."""
    m = messages.filter(F.lower(F.trim("role")) == "assistant").select("message_id", F.col("conversation_id").alias("_c")).distinct()
    c = conversations.select(F.col("conversation_id").alias("_c"), "user_id").distinct()
    return feedback.join(m.join(c, "_c").select("message_id", "user_id").distinct(), ["message_id", "user_id"], "left_semi")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty table. The percentage is of all rows, those without sentiment included."""
    t = feedback.agg(
        F.count(F.lit(1)).alias("total"), F.avg("rating").alias("a"), F.count_if(F.col("sentiment") == "helpful").alias("helpful"), F.count_if(F.col("sentiment") == "not_helpful").alias("not_helpful")
    )
    return t.select("total", F.round(F.coalesce("a", F.lit(0.0)), 2).alias("avg_rating"), "helpful", "not_helpful", tx.percent(F.col("helpful"), F.col("total")).alias("helpful_percent"))


def rating_distribution(feedback: DataFrame) -> DataFrame:
    """Count of each rating from 1 to 5, zeros included."""
    all_ = feedback.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    n = feedback.groupBy(F.col("rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    return all_.join(n, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def issue_breakdown(feedback: DataFrame) -> DataFrame:
    return feedback.filter("issue_type is not null and issue_type <> ''").groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def recent_comments(feedback: DataFrame, most: int = 10) -> DataFrame:
    return feedback.filter("comment is not null and comment <> ''").orderBy(F.desc("submitted_at"), "feedback_id").limit(most)


def context_block(rank: Column, title: Column, file: Column, text: Column) -> Column:
    """A numbered source for a prompt; a dash in place of a missing number."""
    return F.format_string("[%s] %s (%s)\n%s\n", F.coalesce(rank.cast("string"), F.lit("-")), F.coalesce(title, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(text, F.lit("")))


def contexts(retrieved: DataFrame, key: str = "message_id") -> DataFrame:
    """Sources of each message in order of rank, joined: all that were retrieved for it, each once; a source without rank comes last."""
    block = context_block(F.col("rank"), F.col("titre"), F.col("source_file"), F.col("texte"))
    blocks = retrieved.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), block.alias("b")))).alias("s"))
    return blocks.select(key, F.array_join(F.transform("s", lambda x: x["b"]), "\n").alias("context"), F.size("s").alias("n_sources"))


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the patches' values where there are any."""
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns]).dropDuplicates([key])
    out = rows.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_p_{c}", c))
    return out.drop(*[f"_p_{c}" for c in columns])


def facets(df: DataFrame, equal: dict[str, object], time: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows with the given values, and within [since, until) by time: filters that reach the scan."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    if since is not None:
        df = df.filter(F.col(time) >= since)
    return df if until is None else df.filter(F.col(time) < until)


def payloads(retrieved: DataFrame) -> DataFrame:
    """Retrieved rows as a client gets them: flat fields, scores to 3 digits, and what is known of the chunk nested below raw_meta."""
    meta = F.from_json("raw_meta", "chunk_id long")
    return retrieved.select("message_id", "retrieved_id", F.coalesce("titre", F.lit("")).alias("title"), F.col("texte").alias("text"), F.col("source_file").alias("source"), F.round("score", 3).alias("score"), meta.alias("raw_meta"))
