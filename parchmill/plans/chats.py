"""Queries over conversations, messages and feedback, and over events as streams have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chat
from ..streaming import incremental


def _table(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _conversations(spark, d: str):
    return chat.latest(_table(spark, d, "chat_conversations"), "conversation_id", "updated_at", ["user_id", "title", "created_at", "is_deleted"])


#: What decides between deliveries of a message at the same time.
DECIDING = ("conversation_id", "role", "content", "created_at")


def _messages(spark, d: str, *columns: str):
    """Each message as last delivered. Without content where no column of a query needs it: equal deliveries then differ in nothing that is asked."""
    return chat.latest(_table(spark, d, "chat_messages"), "message_id", "ingested_at", columns or DECIDING)


def conversation_list(spark, d):
    live = _conversations(spark, d).filter("not is_deleted")
    counted = chat.message_counts(live, _messages(spark, d, "conversation_id"))
    return counted.select("conversation_id", "user_id", "message_count", F.unix_micros("updated_at").alias("updated_us")).orderBy(F.desc("updated_us"), "conversation_id")


def conversation_nested(spark, d):
    n = chat.nested_messages(_messages(spark, d), _table(spark, d, "retrieved_chunks").dropDuplicates(["retrieved_id"]))
    ids = F.array_join(F.transform("messages", lambda m: m["message_id"]), ",")
    sources = F.aggregate("messages", F.lit(0), lambda s, m: s + F.coalesce(F.size(m["chunks"]), F.lit(0)))
    parts = n.select("conversation_id", "part", F.size("messages").alias("n"), ids.alias("ids"), sources.alias("n_sources"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])
    return parts.groupBy("conversation_id").agg(F.sum("n").alias("n"), F.array_join(in_order, ",").alias("message_ids"), F.sum("n_sources").alias("n_sources"))


def first_user_message(spark, d):
    f = chat.first_messages(_messages(spark, d), "user")
    return f.select("conversation_id", "message_id", tx.title_of(F.col("content"), "Nouvelle Conversation").alias("title"))


def stale_or_empty_conversations(spark, d):
    now = F.lit("2025-12-31 00:00:00").cast("timestamp")
    return chat.stale_empty(_conversations(spark, d), _messages(spark, d, "conversation_id"), now).select("conversation_id", "user_id")


def message_search(spark, d):
    m = _messages(spark, d).join(_conversations(spark, d).select("conversation_id", F.col("title").alias("conversation_title")), "conversation_id")
    return chat.search(m, ["content", "conversation_title"], "option module").select("message_id", "conversation_id")


def message_page(spark, d):
    p = chat.page(_messages(spark, d, "conversation_id", "created_at").filter("created_at is not null"), [F.desc("created_at"), F.col("message_id")], 2, 20)
    return p.select("message_id", F.unix_micros("created_at").alias("created_us"))


def message_checks(spark, d):
    v = chat.valid_messages(_messages(spark, d))
    return v.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def role_map(spark, d):
    r = tx.model_role(F.lower(F.trim("role")))
    return _messages(spark, d).groupBy(r.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(tx.token_estimate(F.col("content"))).alias("tokens"))


def prompt_contexts(spark, d):
    c = chat.contexts(_table(spark, d, "retrieved_chunks"))
    return c.select("message_id", "n_sources", F.md5("context").alias("context_md5"))


def soft_delete_projection(spark, d):
    now = F.lit("2025-12-31 00:00:00").cast("timestamp")
    c, m = _conversations(spark, d), _messages(spark, d, "conversation_id")
    gone = chat.stale_empty(c, m, now)
    out = chat.soft_deleted(c, gone, "stale_empty", now)
    return out.select("conversation_id", "is_deleted", "deleted_reason", F.unix_micros("updated_at").alias("updated_us"))


def feedback_analytics(spark, d):
    return chat.feedback_summary(_table(spark, d, "feedback"))


def rating_distribution(spark, d):
    return chat.rating_distribution(_table(spark, d, "feedback"))


def issue_breakdown(spark, d):
    return chat.issue_breakdown(_table(spark, d, "feedback"))


def recent_comments(spark, d):
    return chat.recent_comments(_table(spark, d, "feedback")).select("feedback_id", "comment", "rating", F.unix_micros("submitted_at").alias("submitted_us"))


def feedback_upsert_latest(spark, d):
    m = chat.merged_feedback(_table(spark, d, "feedback"))
    return m.select("message_id", F.col("rating").cast("int").alias("rating"), "sentiment", "issue_type", "comment", F.unix_micros("submitted_at").alias("submitted_us"))


def feedback_checks(spark, d):
    v = chat.valid_feedback(_table(spark, d, "feedback"))
    return v.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def feedback_rateable(spark, d):
    return chat.rateable(_table(spark, d, "feedback"), _messages(spark, d, "conversation_id", "role"), _conversations(spark, d)).select("feedback_id", "message_id")


def rate_limit_windows(spark, d):
    w = incremental.rate_limited(_table(spark, d, "events"), "user_id", "ts", 1, "1 hour")
    return w.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "user_id", "n")


def latency_by_window(spark, d):
    w = incremental.windowed_latency(_table(spark, d, "events"), "ts", "value", "event_type", "1 day")
    return w.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "event_type", "n", "mean", "worst")


def payload_fields(spark, d):
    e = _table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def user_activity(spark, d):
    """Conversations and messages of each user: a join through two keys."""
    c, m = _conversations(spark, d), _messages(spark, d, "conversation_id")
    j = m.join(c.select("conversation_id", "user_id"), "conversation_id")
    return j.groupBy("user_id").agg(F.countDistinct("conversation_id").alias("conversations"), F.count(F.lit(1)).alias("messages"))


def message_facets(spark, d):
    since, until = (F.lit(x).cast("timestamp") for x in ("2025-03-01", "2025-09-01"))
    m = chat.facets(_messages(spark, d, "role", "created_at"), {"role": "user"}, "created_at", since, until)
    return m.select("message_id", F.unix_micros("created_at").alias("created_us"))


def retrieved_payloads(spark, d):
    p = chat.payloads(_table(spark, d, "retrieved_chunks").select("message_id", "retrieved_id", "titre", "texte", "source_file", "score", "raw_meta").distinct())
    return p.select("message_id", "retrieved_id", "title", "source", "score", F.col("raw_meta.chunk_id").alias("chunk_id"), F.md5("text").alias("text_md5"))


def recent_by_user(spark, d):
    """The title of each user's last conversation before those of the others, three at most, in order of time."""
    c = _conversations(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("created_at").alias("t"), "conversation_id"))).alias("own"), F.max_by("conversation_id", F.struct("updated_at", "conversation_id")).alias("last"))
    ids = F.filter(F.transform("own", lambda x: x["conversation_id"]), lambda x: x != F.col("last"))
    return c.select("user_id", F.array_join(tx.prepended(ids, F.col("last"), 3), ",").alias("recent"))


def error_messages(spark, d):
    """What bodies of errors say, made of the comments of the feedback."""
    c = F.regexp_replace("comment", r"[^A-Za-z ]", "")
    kind = F.pmod(F.length("feedback_id") + F.length(c), F.lit(4))
    body = F.when(kind == 0, F.concat(F.lit('{"detail": "'), c, F.lit('"}'))).when(kind == 1, F.concat(F.lit('{"rating": ["'), c, F.lit('", "x"]}'))).when(kind == 2, F.concat(F.lit('{"rating": "'), c, F.lit('"}'))).otherwise(c)
    return _table(spark, d, "feedback").filter("comment is not null").select("feedback_id", tx.error_message(body).alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        conversation_list, conversation_nested, first_user_message, stale_or_empty_conversations, message_search, message_page, message_checks, role_map, prompt_contexts, soft_delete_projection, feedback_analytics,
        rating_distribution, issue_breakdown, recent_comments, feedback_upsert_latest, feedback_checks, feedback_rateable, rate_limit_windows, latency_by_window, payload_fields, user_activity, message_facets, retrieved_payloads, recent_by_user, error_messages,
    )
}

_B = """with c as (select * from chat_conversations qualify row_number() over (partition by conversation_id order by updated_at desc, user_id desc, title desc) = 1),
m as (select * from chat_messages qualify row_number() over (partition by message_id order by ingested_at desc, conversation_id desc, role desc nulls last, content desc nulls last) = 1) """
_LASTV = "arg_max({0}, {{'t': submitted_at, 'i': feedback_id}}) filter ({0} is not null and trim({0}::varchar) <> '') as {0}"
_STALE = "c.conversation_id not in (select conversation_id from m) and created_at < timestamptz '2025-12-30 23:55:00+00'"
SQL = {
    "message_facets": _B + "select message_id, epoch_us(m.created_at) as created_us from m where role = 'user' and m.created_at >= timestamptz '2025-03-01 00:00:00+00' and m.created_at < timestamptz '2025-09-01 00:00:00+00'",
    "retrieved_payloads": "select message_id, retrieved_id, coalesce(titre, '') as title, source_file as source, round(score, 3) as score, (raw_meta->>'$.chunk_id')::bigint as chunk_id, md5(texte) as text_md5 from (select distinct message_id, retrieved_id, titre, texte, source_file, score, raw_meta from retrieved_chunks)",
    "recent_by_user": _B + """, l as (select user_id, arg_max(conversation_id, {'t': updated_at, 'c': conversation_id}) as last from c group by 1)
select user_id, array_to_string((list_prepend(last, list_filter(list(conversation_id order by created_at nulls first, conversation_id), lambda x: x <> last)))[1:3], ',') as recent from c join l using (user_id) group by user_id, last""",
    "error_messages": """with f as (select feedback_id, regexp_replace(comment, '[^A-Za-z ]', '', 'g') as c from feedback where comment is not null), k as (select *, (length(feedback_id) + length(c)) % 4 as k from f)
select feedback_id, case k when 0 then c when 1 then 'rating: ' || c when 2 then 'rating: ' || c end as message from k""",
    "conversation_list": _B + "select c.conversation_id, user_id, count(m.message_id) as message_count, epoch_us(any_value(updated_at)) as updated_us from c left join m using (conversation_id) where not is_deleted group by 1, 2",
    "conversation_nested": _B + """, r as (select message_id, count(distinct retrieved_id) as k from retrieved_chunks group by 1)
select conversation_id, count(*) as n, string_agg(message_id, ',' order by created_at nulls first, message_id) as message_ids, coalesce(sum(k), 0)::bigint as n_sources from m left join r using (message_id) group by 1""",
    "first_user_message": _B + r"""select conversation_id, message_id, case when t = '' or t is null then 'Nouvelle Conversation' when length(t) > 60 then substring(t, 1, 57) || '...' else t end as title
 from (select *, trim(regexp_replace(trim(content, ' '), '^["''`]+|["''`]+$', '', 'g'), ' ') as t from m where lower(trim(role)) = 'user' and created_at is not null qualify row_number() over (partition by conversation_id order by created_at, message_id) = 1)""",
    "stale_or_empty_conversations": _B + f"select conversation_id, user_id from c where {_STALE}",
    "message_search": _B + "select message_id, conversation_id from m join c using (conversation_id) where (contains(lower(content), 'option') or contains(lower(title), 'option')) and (contains(lower(content), 'module') or contains(lower(title), 'module'))",
    "message_page": _B + "select message_id, epoch_us(m.created_at) as created_us from m where created_at is not null order by m.created_at desc, message_id limit 20 offset 20",
    "message_checks": _B + r"select case when role is null or role not in ('user', 'assistant', 'system') then 'role' when not coalesce(regexp_matches(content, '[^\s\p{Z}]'), false) then 'blank' when role = 'user' and length(content) > 2000 then 'too_long' else 'none' end as error, count(*) as n from m group by 1",
    "role_map": _B + "select case when lower(trim(role)) = 'assistant' then 'model' else lower(trim(role)) end as role, count(*) as n, sum(length(content) // 4)::bigint as tokens from m group by 1",
    "prompt_contexts": """with b as (select distinct message_id, rank, '[' || coalesce(rank::varchar, '-') || '] ' || coalesce(titre, '') || ' (' || coalesce(source_file, '') || ')' || chr(10) || coalesce(texte, '') || chr(10) as b from retrieved_chunks)
select message_id, count(*) as n_sources, md5(string_agg(b, chr(10) order by rank nulls last, b)) as context_md5 from b group by 1""",
    "soft_delete_projection": _B + f"select conversation_id, is_deleted or ({_STALE}) as is_deleted, case when {_STALE} then 'stale_empty' end as deleted_reason, epoch_us(case when {_STALE} then timestamptz '2025-12-31 00:00:00+00' else updated_at end) as updated_us from c",
    "feedback_analytics": "select count(*) as total, round(coalesce(avg(rating), 0), 2) as avg_rating, count(*) filter (sentiment = 'helpful') as helpful, count(*) filter (sentiment = 'not_helpful') as not_helpful, round(count(*) filter (sentiment = 'helpful') * 100 / count(*), 1) as helpful_percent from feedback",
    "rating_distribution": "select r::int as rating, count(f.feedback_id) as n from range(1, 6) q(r) left join feedback f on f.rating = r group by 1",
    "issue_breakdown": "select issue_type, count(*) as n from feedback where issue_type <> '' group by 1",
    "recent_comments": "select feedback_id, comment, rating, epoch_us(submitted_at) as submitted_us from feedback where comment <> '' order by submitted_at desc, feedback_id limit 10",
    "feedback_upsert_latest": "select message_id, " + ", ".join(_LASTV.format(c) for c in ("rating", "sentiment", "issue_type", "comment")) + ", epoch_us(max(submitted_at)) as submitted_us from feedback group by 1",
    "feedback_checks": "select case when rating is not null and rating not between 1 and 5 then 'rating' when rating is null and coalesce(trim(sentiment), '') = '' and coalesce(trim(issue_type), '') = '' and coalesce(trim(comment), '') = '' then 'nothing' else 'none' end as error, count(*) as n from feedback group by 1",
    "feedback_rateable": _B + "select feedback_id, f.message_id from feedback f where exists (select 1 from m join c using (conversation_id) where m.message_id = f.message_id and c.user_id = f.user_id and lower(trim(m.role)) = 'assistant')",
    "rate_limit_windows": "select epoch_us(time_bucket(interval '1 hour', ts)) as window_us, user_id, count(*) as n from events group by 1, 2 having count(*) > 1",
    "latency_by_window": "select epoch_us(time_bucket(interval '1 day', ts)) as window_us, event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as worst from events group by 1, 2",
    "payload_fields": "select event_type, count(props->>'$.k') as n, sum((props->>'$.k')::bigint)::bigint as sum_k, max((props->>'$.k')::bigint) as max_k from events group by 1",
    "user_activity": _B + "select user_id, count(distinct conversation_id) as conversations, count(*) as messages from m join c using (conversation_id) group by 1",
}
