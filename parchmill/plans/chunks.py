"""Queries over chunks and their retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import media, scoring
from ..functions import text as tx
from ..operators import chat, profile


def _chunks(spark, d: str, *columns: str) -> DataFrame:
    """Chunks, each chunk_id once, with the columns asked for and no others."""
    c = spark.read.parquet(f"{d}/chunks.parquet").withColumn("score", F.col("validation_score.final_score"))
    return chat.latest(c, "chunk_id", "chunked_at", columns)


def chunk_features(spark, d):
    f = media.features(F.col("text"))
    rows = _chunks(spark, d, "text").select("chunk_id", f.alias("f"))
    return rows.select("chunk_id", "f.total_images", "f.total_tables", "f.total_code_blocks", "f.has_media", tx.content_type(F.col("f.total_code_blocks"), F.col("f.total_tables"), F.col("f.total_images")).alias("content_type"), F.md5(F.array_join("f.table_summary", "\n")).alias("rows_md5"))


def chunk_types(spark, d):
    t = F.col("text")
    return _chunks(spark, d, "text").select("chunk_id", tx.block_type(t).alias("block_type"), tx.only_marker(t).alias("only_marker"), tx.boundary_issue(t).alias("starts_inside"), (tx.token_estimate(t) < 20).alias("low_content"))


def strategy_acceptance(spark, d):
    return profile.acceptance_by(_chunks(spark, d, "chunking_method", "validation_status"), "chunking_method")


def retry_histogram(spark, d):
    return profile.histogram(_chunks(spark, d, "retry_depth"), "retry_depth")


def boundary_fraction(spark, d):
    return profile.fraction(_chunks(spark, d, "boundary_issue"), F.col("boundary_issue"), "fraction")


def per_file_report(spark, d):
    return profile.score_summary(_chunks(spark, d, "relative_path", "score", "token_count"), ["relative_path"], "score")


def global_chunk_report(spark, d):
    return profile.global_report(_chunks(spark, d, "relative_path", "score", "validation_status", "chunking_status", "low_content"), "relative_path", "score")


def running_tokens_per_file(spark, d):
    rows = _chunks(spark, d, "relative_path", "text").select("relative_path", "chunk_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return profile.running_total(rows, ["relative_path"], ["chunk_id"], "tokens", "file_tokens")


def chunk_ordinals(spark, d):
    """Number and total of each chunk in its file, and a new id over all, range by range."""
    rows = profile.global_rank(_chunks(spark, d, "folder_path", "relative_path").select("folder_path", "relative_path", "chunk_id"), "folder_path", "relative_path", "chunk_id", name="new_id")
    files = rows.groupBy("folder_path", "relative_path").agg(F.min("new_id").alias("first_id"), F.count(F.lit(1)).alias("total_chunks"))
    return rows.join(files, ["folder_path", "relative_path"]).select("chunk_id", "new_id", (F.col("new_id") - F.col("first_id") + 1).alias("chunk_no"), "total_chunks")


def accepted_by_folder(spark, d):
    ok = _chunks(spark, d, "folder_path", "relative_path", "validation_status").filter(F.col("validation_status").isin(*profile.ACCEPTED))
    return ok.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_chunk"), F.countDistinct("relative_path").alias("files"))


def media_grouping_sets(spark, d):
    return profile.counts_by_each(_chunks(spark, d, "content_type", "chunking_method"), "content_type", "chunking_method")


def judge_scores(spark, d):
    """Scores out of raw answers: whole, cut off at the end, with a criterion missing, out of range, or no JSON at all."""
    c = spark.read.parquet(f"{d}/chunks.parquet").select("chunk_id", *[F.col(f"validation_score.{x}").alias(x) for x in (*scoring.CRITERIA, "final_score")]).distinct()
    item = lambda x: F.concat(F.lit(f'"{x}": '), F.col(x).cast("string"))
    head = F.concat_ws(", ", *[item(x) for x in scoring.CRITERIA[:4]])
    kind = F.pmod(F.col("chunk_id"), F.lit(5))
    raw = (
        F.when(kind == 0, F.concat(F.lit("Scores: {"), head, F.lit(", "), item("fidelity"), F.lit(", "), item("final_score"), F.lit("} end")))
        .when(kind == 1, F.concat(F.lit("{"), head, F.lit(', "fid')))
        .when(kind == 2, F.concat(F.lit("{"), F.concat_ws(", ", item("completeness"), item("coherence")), F.lit(', "rel')))
        .when(kind == 3, F.concat(F.lit("{"), head, F.lit(', "fidelity": 1.7}')))
        .otherwise(F.lit("no score"))
    )
    rows = scoring.with_scores(c.select("chunk_id", raw.alias("raw")), "raw", "s")
    return rows.select("chunk_id", "s.completeness", "s.fidelity", "s.final_score", "s.llm_final_score")


def retrieved_positions(spark, d):
    """Where a retrieved text begins in its chunk, and the first of the retrieved rows of each message."""
    r = spark.read.parquet(f"{d}/retrieved_chunks.parquet").withColumn("chunk_id", F.get_json_object("raw_meta", "$.chunk_id").cast("long"))
    c = _chunks(spark, d, "text").select("chunk_id", F.col("text").alias("chunk"))
    rows = r.join(c, "chunk_id").select("retrieved_id", "chunk_id", tx.start_in(F.col("chunk"), F.col("texte")).alias("start"), tx.line_number(F.col("chunk"), tx.start_in(F.col("chunk"), F.col("texte"))).alias("line"))
    return rows.distinct()


def retrieval_ranks(spark, d):
    r = spark.read.parquet(f"{d}/retrieved_chunks.parquet").filter("score is not null").select("message_id", "retrieved_id", "score").distinct()
    w = W.partitionBy("message_id").orderBy(F.desc("score"), "retrieved_id")
    return r.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("message_id", "retrieved_id", "rank", F.round("score", 4).alias("score"))


def status_by_file(spark, d):
    return profile.status_by_file(_chunks(spark, d, "relative_path", "validation_status"), "relative_path")


def report_by_folder(spark, d):
    """Chunks, files and tokens of each folder, and in all how many folders."""
    c = _chunks(spark, d, "folder_path", "relative_path", "token_count")
    per = c.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("relative_path").alias("files"), F.sum("token_count").alias("tokens"))
    return per.crossJoin(F.broadcast(c.agg(F.countDistinct("folder_path").alias("folders"))))  # one row


QUERIES = {
    f.__name__: f
    for f in (
        chunk_features, chunk_types, strategy_acceptance, retry_histogram, boundary_fraction, per_file_report, global_chunk_report, running_tokens_per_file, chunk_ordinals, accepted_by_folder,
        media_grouping_sets, judge_scores, retrieved_positions, retrieval_ranks, status_by_file, report_by_folder,
    )
}

_C = """with c as (select *, validation_score.final_score as score from chunks
 qualify row_number() over (partition by chunk_id order by chunked_at desc nulls last) = 1) """
_OK = "validation_status in ('accepted', 'accepted_max_depth')"
_IMG = r"(?i)!\[[^\n]*?\]\([^\n]*?\)|<img[^>]*>|\[IMAGE[^\]]*\]|\[IMG[_\d]*\]|<IMAGE[^>]*>"
_COD = r"```[\s\S]*?```|`[^`\n]+`"
SQL = {
    "status_by_file": _C + f"select relative_path, count(*) as n_chunks, count(*) filter (validation_status = 'accepted') as accepted, count(*) filter (validation_status = 'accepted_max_depth') as accepted_max_depth, count(*) filter (not coalesce({_OK}, false)) as other from c group by 1",
    "report_by_folder": _C + "select folder_path, count(*) as n_chunks, count(distinct relative_path) as files, sum(token_count)::bigint as tokens, (select count(distinct folder_path) from c) as folders from c group by 1",
    "chunk_features": _C + rf""", f as (select chunk_id, len(regexp_extract_all(text, '{_IMG}')) as i, regexp_extract_all(text, '\|[^\n]+\|[^\n]+\|') as t, len(regexp_extract_all(text, '{_COD}')) as k from c)
select chunk_id, i as total_images, len(t) as total_tables, k as total_code_blocks, i > 0 or len(t) > 0 as has_media, case when k > 0 then 'code' when len(t) > 0 then 'table' when i > 0 then 'image_section' else 'text' end as content_type,
 md5(array_to_string(t[1:10], chr(10))) as rows_md5 from f""",
    "chunk_types": _C + r"""select chunk_id, case when contains(text, '[CODE') or contains(text, '```') or regexp_matches(text, '(?m)^[ \t]{4,}\S') then 'code'
 when contains(text, '[TABLE') or length(text) - length(replace(text, '|', '')) >= 4 then 'table' when regexp_matches(text, '(?m)^[ \t]*[-*•][ \t]') then 'bullet_list'
 when regexp_matches(text, '(?m)^[ \t]*\d+[.)][ \t]') then 'numbered_list' when contains(text, '[IMAGE') then 'image_section' else 'prose' end as block_type,
 regexp_matches(text, '(?i)^\s*(\[(IMAGE|TABLE|IMG)[^\]]*\]|<IMAGE[^>]*>)\s*$') as only_marker,
 case when regexp_replace(text, '^\s+', '') = '' then false else (lower(regexp_replace(text, '^\s+', '')[1]) = regexp_replace(text, '^\s+', '')[1] and upper(regexp_replace(text, '^\s+', '')[1]) <> regexp_replace(text, '^\s+', '')[1])
  or contains(',.;:!?)]}', regexp_replace(text, '^\s+', '')[1]) end as starts_inside, length(text) // 4 < 20 as low_content from c""",
    "strategy_acceptance": _C + f"select chunking_method, count(*) as total, count(*) filter ({_OK}) as accepted, round(count(*) filter ({_OK}) / count(*), 4) as acceptance_rate from c group by 1",
    "retry_histogram": _C + "select retry_depth, count(*) as n from c group by 1",
    "boundary_fraction": _C + "select round(avg(boundary_issue::int), 4) as fraction, count(*) as n from c",
    "per_file_report": _C + "select relative_path, count(*) as n_chunks, sum(token_count)::bigint as total_tokens, round(avg(score), 6) as avg_score, min(score) as min_score, max(score) as max_score from c group by 1",
    "global_chunk_report": _C + f"""select count(distinct relative_path) as files, count(*) as chunks, count(*) filter ({_OK}) as accepted, count(*) filter (chunking_status = 'original_untouched') as passthrough,
 count(*) filter (low_content) as low_content, round(avg(score), 6) as avg_score, min(score) as min_score, max(score) as max_score from c""",
    "running_tokens_per_file": _C + "select relative_path, chunk_id, length(text) // 4 as tokens, sum(length(text) // 4) over (partition by relative_path order by chunk_id rows unbounded preceding)::bigint as file_tokens from c",
    "chunk_ordinals": _C + "select chunk_id, row_number() over (order by folder_path, relative_path, chunk_id) as new_id, row_number() over (partition by folder_path, relative_path order by chunk_id) as chunk_no, count(*) over (partition by folder_path, relative_path) as total_chunks from c",
    "accepted_by_folder": _C + f"select folder_path, count(*) as n, min(chunk_id) as first_chunk, count(distinct relative_path) as files from c where {_OK} group by 1",
    "media_grouping_sets": _C + "select content_type, chunking_method, count(*) as n from c group by grouping sets ((content_type), (chunking_method), ())",
    "judge_scores": """with s as (select distinct chunk_id, chunk_id % 5 as k, validation_score.completeness as co, validation_score.coherence as ch, validation_score.relevance as re, validation_score.boundary as bo,
 validation_score.fidelity as fi, validation_score.final_score as fs from chunks),
t as (select chunk_id, k, co, ch, re, bo, case k when 0 then fi when 1 then round((co + ch + re + bo) / 4, 3) when 3 then 1.0 end as f, case when k = 0 then fs else 0.0 end as own from s)
select chunk_id, case when k in (0, 1, 3) then co end as completeness, f as fidelity, case when k in (0, 1, 3) then round(co * 0.2 + ch * 0.15 + re * 0.15 + bo * 0.1 + f * 0.4, 4) end as final_score, case when k in (0, 1, 3) then own end as llm_final_score from t""",
    "retrieved_positions": _C + """, r as (select distinct retrieved_id, (raw_meta->>'$.chunk_id')::bigint as chunk_id, texte from retrieved_chunks),
p as (select retrieved_id, chunk_id, text, greatest(instr(text, substring(texte, 1, 60)) - 1, 0) as start from r join c using (chunk_id))
select distinct retrieved_id, chunk_id, start, length(substring(text, 1, start)) - length(replace(substring(text, 1, start), chr(10), '')) + 1 as line from p""",
    "retrieval_ranks": """select message_id, retrieved_id, row_number() over (partition by message_id order by score desc, retrieved_id) as rank, round(score, 4) as score from (select distinct message_id, retrieved_id, score from retrieved_chunks where score is not null)
 qualify rank <= 3""",
}
