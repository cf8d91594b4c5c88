"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..functions import text as tx
from ..operators import assembly, chunking, pairing, profile, quality
from . import chunk_sql


def _documents(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _judged(spark, d: str) -> DataFrame:
    return quality.dispositions(_documents(spark, d).select("doc_id", "text", "has_images"), "text", "doc_id", "has_images")


def clean_disposition_counts(spark, d):
    return quality.disposition_counts(_judged(spark, d))


def useless_reason_rows(spark, d):
    t = _documents(spark, d).select("doc_id", "has_images", tx.collapse(F.col("text")).alias("t"))
    return t.select("doc_id", quality.useless_reason(F.col("t"), F.col("has_images")).alias("reason")).filter("reason is not null")


def exact_dedup_first_wins(spark, d):
    return _judged(spark, d).filter(F.col("disposition").startswith("kept")).select("doc_id", "disposition")


def duplicates_map(spark, d):
    return quality.duplicate_map(_judged(spark, d), "doc_id")


def corpus_size_reduction(spark, d):
    pages = _documents(spark, d).select("doc_id", "text", "has_images", F.octet_length("text").cast("long").alias("bytes"))
    return quality.size_reduction(quality.dispositions(pages, "text", "doc_id", "has_images", ["bytes"]), F.col("bytes"))


def url_share_rows(spark, d):
    return _documents(spark, d).select("doc_id", F.round(tx.url_share(F.col("text")), 6).alias("url_share"), quality.url_only(F.col("text"), F.col("has_images")).alias("url_only"))


def page_visible_text(spark, d):
    t = tx.visible_text(F.col("text"))
    return _documents(spark, d).select("doc_id", F.length(t).alias("visible_chars"), tx.text_md5(t).alias("visible_md5"), quality.has_image(F.col("text")).alias("markup_image"))


def content_keys(spark, d):
    return _documents(spark, d).select("doc_id", tx.content_key(F.col("text")).alias("content_key"), tx.pair_key(F.col("title"), F.col("text")).alias("pair_key"))


def path_parts(spark, d):
    parts = tx.path_parts(F.col("relative_path"))
    return _documents(spark, d).select("doc_id", *[parts[n].alias(n) for n in ("file", "folder_path", "folder_depth", "space", "stem", "extension")])


def page_slugs(spark, d):
    s = tx.slug(F.concat(F.lit("x/content/"), F.col("relative_path"), F.lit(".md")))
    return _documents(spark, d).select("doc_id", s.alias("slug"), tx.title_from_slug(F.regexp_replace("source", "_", "-")).alias("source_title"), tx.route(F.col("relative_path")).alias("route"), tx.description_of(F.col("text")).alias("description"))


def safe_names(spark, d):
    return _documents(spark, d).select("doc_id", tx.safe_name(F.col("title")).alias("safe_name"), tx.shortened(F.col("title"), 20).alias("short_title"), tx.preview(F.col("text"), 60).alias("preview"))


def token_counts(spark, d):
    t = F.col("text")
    return _documents(spark, d).select("doc_id", tx.word_count(t).alias("words"), tx.long_word_count(t).alias("long_words"), tx.token_estimate(t).alias("tokens"), tx.human_size(F.octet_length("text")).alias("size"))


def token_profile_rollup(spark, d):
    return profile.token_statistics(_documents(spark, d), tx.word_count(F.col("text")), ["source", "has_images"], rollup=True)


def token_percentiles(spark, d):
    return profile.index_percentiles(_documents(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("tokens")), "tokens", "doc_id")


def token_rank_listing(spark, d):
    return profile.global_rank(_documents(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("tokens")), "tokens", "doc_id")


def running_tokens_per_source(spark, d):
    rows = _documents(spark, d).select("source", "doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return profile.running_total(rows, ["source"], ["doc_id"], "tokens")


def counts_grouping_sets(spark, d):
    return profile.counts_by_each(_documents(spark, d), "source", "has_images")


def line_offsets(spark, d):
    return chunking.lines(_documents(spark, d).filter("text is not null"), "doc_id", "text").select(F.col("id").alias("doc_id"), "line_no", "char_offset", F.length("line").alias("line_chars"))


def page_sections(spark, d):
    s = chunking.sections(_documents(spark, d), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), "section_no", "start_pos", "type", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


def semantic_units(spark, d):
    u = chunking.semantic_units(_documents(spark, d).filter("text is not null"), "doc_id", "text")
    return u.select(F.col("id").alias("doc_id"), "unit_no", "type", "tokens", "start_pos", F.length("unit").alias("unit_chars"))


def force_split_chunks(spark, d):
    c = chunking.force_split(_documents(spark, d).filter("text is not null"), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), "chunk_no", F.md5("chunk").alias("chunk_md5"))


def sentence_chunks(spark, d):
    return chunking.chunks(_documents(spark, d), "doc_id", "text", "sentence").withColumnRenamed("id", "doc_id")


def smaller_chunks(spark, d):
    return chunking.chunks(_documents(spark, d), "doc_id", "text", "smaller").withColumnRenamed("id", "doc_id")


def paragraph_chunks(spark, d):
    return chunking.chunks(_documents(spark, d), "doc_id", "text", "paragraph").withColumnRenamed("id", "doc_id")


def recursive_chunks(spark, d):
    return chunking.chunks(_documents(spark, d), "doc_id", "text", "recursive_character").withColumnRenamed("id", "doc_id")


def semantic_chunks(spark, d):
    return chunking.semantic_chunks(_documents(spark, d), "doc_id", "text").withColumnRenamed("id", "doc_id")


def plain_scorer(chunk, original):
    """A scorer without a model: whole sentences and a share of long words."""
    ends = chunk.rlike(r"[.!?]\s*$").cast("double")
    long_ = F.coalesce(F.try_divide(tx.long_word_count(chunk).cast("double"), tx.word_count(chunk).cast("double")), F.lit(0.0))
    return F.round(0.4 * ends + 0.6 * long_, 4)


plain_scorer.reads_original = False


def rechunked(spark, d):
    kept = chunking.rechunk(_documents(spark, d), "doc_id", "text", plain_scorer)
    return chunking.numbered(kept).select(F.col("id").alias("doc_id"), "chunk_id", "chunk_no", "total_chunks", "status", "method", "retry_depth", "score", F.length("chunk").alias("chars"))


def chunk_entries(spark, d):
    e = assembly.chunk_entries(_documents(spark, d), "doc_id", "text", plain_scorer)
    return e.drop("text", "image_summary").withColumnRenamed("id", "doc_id")


def incremental_pending(spark, d):
    now = _documents(spark, d).select("relative_path", F.md5("text").alias("digest"), "doc_id", "updated_at", "text")
    one = now.groupBy("relative_path").agg(F.min(F.struct("doc_id", "digest", "text", "updated_at")).alias("r")).select("relative_path", "r.*")
    before = one.filter(F.col("updated_at") < F.lit("2025-07-01").cast("timestamp")).select("relative_path", F.md5(F.rtrim("text")).alias("digest"))
    return pairing.changes(one.select("relative_path", "digest"), before, "relative_path", "digest").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def image_positions(spark, d):
    p = _documents(spark, d).select("doc_id", F.explode(media.positions(F.col("text"), r"\[IMAGE[^\]]*\]")).alias("p"))
    return p.select("doc_id", "p.ordinal", "p.char_in_chunk", "p.line_number", "p.marker_length", media.mark_id(F.col("p.marker"), "IMAGE", F.col("p.ordinal")).alias("image_id"), F.md5("p.before").alias("before_md5"), F.md5("p.after").alias("after_md5"))


def bounds_enforced(spark, d):
    return chunking.bounded_lines(_documents(spark, d), "doc_id", "text").select(F.col("id").alias("doc_id"), "chunk_no", F.md5("chunk").alias("chunk_md5"))


def duplicate_report_rows(spark, d):
    """Each duplicate with the file of its original."""
    docs = _documents(spark, d)
    judged = quality.dispositions(docs.select("doc_id", "text", "has_images", "relative_path"), "text", "doc_id", "has_images", ["relative_path"]).filter("disposition = 'duplicate'")
    return judged.join(docs.select(F.col("doc_id").alias("original"), F.col("relative_path").alias("original_path")), "original").select("doc_id", "original", "relative_path", "original_path")


def html_entity_clean(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(tx.entities_decoded(F.concat(F.lit("a&nbsp;&amp;&eacute; "), F.col("text")))).alias("clean_md5"))


def _paired(spark, d):
    """Pages as texts and pages with images as their companions, by folder and source file."""
    docs = _documents(spark, d).filter("doc_id is not null").select("doc_id", "folder_name", "source_file", "has_images")
    return docs.filter("not coalesce(has_images, false)").drop("has_images"), docs.filter("has_images").drop("has_images")


def companion_pairing(spark, d):
    a, b = _paired(spark, d)
    return pairing.with_companion(a, b, ["folder_name", "source_file"], "doc_id").select("doc_id", "companion")


def standalone_anti(spark, d):
    a, b = _paired(spark, d)
    return pairing.standalone(b, a, ["folder_name", "source_file"]).select("doc_id")


def _sentences(df, key: str):
    """(key, sentence): distinct sentences of five words or more, lower-cased, blanks made one."""
    parts = F.split(F.regexp_replace(tx.collapse(F.lower("text")), r"([.!?]) ", "$1\u0001"), "\u0001")
    return df.filter("text is not null").select(key, F.explode(parts).alias("sentence")).filter(F.size(F.split("sentence", " ")) >= 5).distinct()


def benchmark_contamination(spark, d):
    """Documents that hold whole sentences of an evaluation item, and how many."""
    items = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "text")
    held = _sentences(_documents(spark, d).select("doc_id", "text"), "doc_id").join(_sentences(items, "item_id"), "sentence")
    return held.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_sentences"))


def folder_listing(spark, d):
    return profile.listing(_documents(spark, d), "folder_name")


QUERIES = {
    f.__name__: f
    for f in (
        clean_disposition_counts, useless_reason_rows, exact_dedup_first_wins, duplicates_map, corpus_size_reduction, url_share_rows, page_visible_text, content_keys, path_parts, page_slugs, safe_names,
        token_counts, token_profile_rollup, token_percentiles, token_rank_listing, running_tokens_per_source, counts_grouping_sets, line_offsets, page_sections, semantic_units, force_split_chunks,
        sentence_chunks, smaller_chunks, paragraph_chunks, recursive_chunks, semantic_chunks, rechunked, chunk_entries, incremental_pending, image_positions,
        bounds_enforced, duplicate_report_rows, html_entity_clean, companion_pairing, standalone_anti, benchmark_contamination, folder_listing,
    )
}

_C = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_WORDS = f"(case when {_C.format('text')} = '' then [] else string_split({_C.format('text')}, ' ') end)"
_URLS = r"regexp_extract_all(text, '(?i)https?://\S+')"
_URL_SHARE = f"case when length(text) = 0 then 0 else coalesce(list_sum(list_transform({_URLS}, lambda x: length(x))), 0) / length(text) end"
_JUDGED = rf"""
with r as (select doc_id, text, has_images, {_C.format("coalesce(text, '')")} as t, {_URL_SHARE} as u from documents),
w as (select *, case when coalesce(has_images, false) then null when t = '' then 'empty' when length(t) < 50 then 'too_short'
  when len(list_filter(string_split(t, ' '), lambda x: length(x) > 2)) < 10 then 'too_few_words' when regexp_matches(lower(t), '^(bienvenue\s*!?|welcome\s*!?|accueil|home)\s*$') then 'greeting' end as reason from r),
x as (select *, case when reason is not null then 'useless' when not coalesce(has_images, false) and coalesce(u, 0) > 0.8 then 'url_only' end as gone from w),
k as (select doc_id, min(doc_id) over (partition by sha256({_C.format("lower(coalesce(text, ''))")})) as original from x where gone is null),
j as (select x.doc_id, x.text, x.has_images, case when gone is not null then gone when k.original <> x.doc_id then 'duplicate' when coalesce(has_images, false) then 'kept_with_images' else 'kept' end as disposition,
  case when k.original <> x.doc_id then k.original end as original, reason from x left join k using (doc_id))
"""
_SIZE = "case when {0} < 1024 then printf('%.2f B', {0}::double) when {0} < 1048576 then printf('%.2f KB', round({0} / 1024.0, 2)) when {0} < 1073741824 then printf('%.2f MB', round({0} / 1048576.0, 2)) else printf('%.2f GB', round({0} / 1073741824.0, 2)) end"
_TITLE = r"regexp_matches({0}, '^#{{1,6}}\s+.+$|^[A-Z][A-Z\s]{{3,}}$|^\d+\.?\s+[A-Z].+$|^[IVX]+\.\s+[A-Z].+$|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*:$')"
_BLOCK = r"""case when contains({0}, '[CODE') or contains({0}, '```') or regexp_matches({0}, '(?m)^[ \t]{{4,}}\S') then 'code'
 when contains({0}, '[TABLE') or length({0}) - length(replace({0}, '|', '')) >= 4 then 'table' when regexp_matches({0}, '(?m)^[ \t]*[-*•][ \t]') then 'bullet_list'
 when regexp_matches({0}, '(?m)^[ \t]*\d+[.)][ \t]') then 'numbered_list' when contains({0}, '[IMAGE') then 'image_section' else 'prose' end"""

def _entities(sql: str) -> str:
    for entity, plain in tx.ENTITIES:
        sql = f"replace({sql}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return sql


_SENTENCE = r"select distinct {0}, s as sentence from (select {0}, unnest(string_split(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) as s from {1} where text is not null) where len(string_split(s, ' ')) >= 5"
SQL = {
    "sentence_chunks": chunk_sql.sentences(chunking.MOST),
    "smaller_chunks": chunk_sql.sentences(chunking.SMALLER),
    "paragraph_chunks": chunk_sql.paragraphs(),
    "bounds_enforced": chunk_sql.lines_bounded(),
    "duplicate_report_rows": _JUDGED + "select j.doc_id, j.original, a.relative_path, b.relative_path as original_path from j join documents a using (doc_id) join documents b on b.doc_id = j.original where disposition = 'duplicate'",
    "html_entity_clean": "select doc_id, md5(" + _C.replace("{0}", "regexp_replace(regexp_replace(" + _entities("('a&nbsp;&amp;&eacute; ' || text)") + r", '[\x{a0}\x{2009}\x{202f}]', ' ', 'g'), '[\x{200b}-\x{200d}\x{feff}]', '', 'g')") + ") as clean_md5 from documents",
    "companion_pairing": "select doc_id, (select min(b.doc_id) from documents b where b.has_images and b.folder_name = a.folder_name and b.source_file = a.source_file) as companion from documents a where not coalesce(has_images, false)",
    "standalone_anti": "select doc_id from documents a where has_images and not exists (select 1 from documents b where not coalesce(b.has_images, false) and b.folder_name = a.folder_name and b.source_file = a.source_file)",
    "benchmark_contamination": f"with d as ({_SENTENCE.format('doc_id', 'documents')}), i as ({_SENTENCE.format('item_id', 'eval_items')}) select doc_id, item_id, count(*) as n_sentences from d join i using (sentence) group by 1, 2",
    "folder_listing": "select folder_name, count(*) as n from documents group by 1",
    "clean_disposition_counts": _JUDGED + "select disposition, count(*) as n from j group by 1",
    "useless_reason_rows": _JUDGED + "select doc_id, reason from j where reason is not null",
    "exact_dedup_first_wins": _JUDGED + "select doc_id, disposition from j where disposition like 'kept%'",
    "duplicates_map": _JUDGED + "select original, doc_id as duplicate, row_number() over (partition by original order by doc_id) as ordinal from j where disposition = 'duplicate'",
    "corpus_size_reduction": _JUDGED + f""", s as (select sum(strlen(text))::bigint as bytes_before, sum(case when disposition like 'kept%' then strlen(text) else 0 end)::bigint as bytes_after from j)
select bytes_before, bytes_after, {_SIZE.format('bytes_before')} as size_before, round((bytes_before - bytes_after) * 100 / bytes_before, 2) as reduction_percent from s""",
    "url_share_rows": f"select doc_id, round({_URL_SHARE}, 6) as url_share, not coalesce(has_images, false) and coalesce({_URL_SHARE}, 0) > 0.8 as url_only from documents",
    "page_visible_text": r"""with t as (select doc_id, text, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as v from documents)
select doc_id, length(v) as visible_chars, md5(v) as visible_md5, regexp_matches(text, '(?i)<img\b|data:image/|base64') as markup_image from t""",
    "content_keys": f"select doc_id, sha256({_C.format('lower(text)')}) as content_key, md5(substring(title, 1, 500) || '|||' || text) as pair_key from documents",
    "path_parts": r"""with p as (select doc_id, string_split(relative_path, '/') as q from documents)
select doc_id, q[-1] as file, array_to_string(q[1:len(q)-1], '/') as folder_path, len(q) - 1 as folder_depth, case when len(q) > 1 then q[1] else 'root' end as space,
 regexp_replace(q[-1], '(.)\.[^.]*$', '\1') as stem, lower(regexp_extract(q[-1], '.(\.[^.]*)$', 1)) as extension from p""",
    "page_slugs": rf"""select doc_id, relative_path as slug, array_to_string(list_transform(list_filter(string_split(replace(source, '_', '-'), '-'), lambda x: x <> ''), lambda x: upper(x[1:1]) || x[2:]), ' ') as source_title,
 '/' || trim(relative_path) as route, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#+\s+', '', 'g'), '(?s)```.*?```', '', 'g'), '[*_`>#-]', ' ', 'g'), '\s+', ' ', 'g')), 1, 160) as description from documents""",
    "safe_names": r"""select doc_id, substring(translate(title, '<>:"/|?*\', '_________'), 1, 100) as safe_name, case when length(title) > 20 then substring(title, 1, 17) || '...' else title end as short_title,
 case when length(text) > 60 then substring(text, 1, 60) || '...' else text end as preview from documents""",
    "token_counts": f"select doc_id, len({_WORDS}) as words, len(list_filter({_WORDS}, lambda x: length(x) > 2)) as long_words, length(text) // 4 as tokens, {_SIZE.format('strlen(text)')} as size from documents",
    "token_profile_rollup": f"select source, has_images, count(*) as n, sum(len({_WORDS}))::bigint as total_tokens, round(avg(len({_WORDS})), 4) as mean_tokens, min(len({_WORDS})) as min_tokens, max(len({_WORDS})) as max_tokens from documents group by rollup (source, has_images)",
    "token_percentiles": f"with t as (select len({_WORDS}) as tokens, row_number() over (order by len({_WORDS}), doc_id) as rank, count(*) over () as n from documents) select p, tokens as value from t join (values (10),(25),(50),(75),(90),(95),(99)) as q(p) on rank = floor(n * p / 100) + 1",
    "token_rank_listing": f"select doc_id, len({_WORDS}) as tokens, row_number() over (order by len({_WORDS}), doc_id) as rank from documents",
    "running_tokens_per_source": "select source, doc_id, length(text) // 4 as tokens, sum(length(text) // 4) over (partition by source order by doc_id rows unbounded preceding)::bigint as running_total from documents",
    "counts_grouping_sets": "select source, has_images, count(*) as n from documents group by grouping sets ((source), (has_images), ())",
    "line_offsets": """with l as (select doc_id, string_split(text, chr(10)) as q from documents where text is not null),
e as (select doc_id, generate_subscripts(q, 1) - 1 as line_no, unnest(q) as line from l)
select doc_id, line_no, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as char_offset, length(line) as line_chars from e""",
    "page_sections": rf"""with l as (select doc_id, string_split(text, chr(10)) as q from documents where text is not null),
e as (select doc_id, generate_subscripts(q, 1) - 1 as n, unnest(q) as line from l),
o as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as pos, trim(line, E' \t\r\n') as bare from e),
t as (select *, {_TITLE.format('bare')} as title, sum(case when {_TITLE.format('bare')} then 0 else 1 end) over (partition by doc_id order by n) as run from o),
k as (select *, case when title then row_number() over (partition by doc_id, run, title order by n) end as k, min(case when title then n end) over (partition by doc_id, run) as first from t),
b as (select *, coalesce(title and (k % 2 = case when first = 0 then 0 else 1 end), false) as brk from k),
s as (select *, sum(brk::int) over (partition by doc_id order by n)::bigint as section_no from b),
g as (select doc_id, section_no, min(pos) as start_pos, coalesce(max(case when brk then bare end), '') as ttl, string_agg(line, chr(10) order by n) filter (not brk) as content, bool_or(not brk) as has from s group by 1, 2)
select doc_id, section_no, start_pos, case when ttl = '' then 'prose' when regexp_matches(ttl, '^#{{1,6}}\s+.+$') then 'markdown_header' when regexp_matches(ttl, '^[A-Z][A-Z\s]{{3,}}$') then 'uppercase_title'
 when regexp_matches(ttl, '^\d+\.?\s+[A-Z].+$') then 'numbered_section' when regexp_matches(ttl, '^[IVX]+\.\s+[A-Z].+$') then 'roman_section' else 'colon_title' end as type, md5(ttl) as title_md5, md5(content) as content_md5 from g where has""".replace("{{", "{").replace("}}", "}"),
    "semantic_units": rf"""with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as q from documents where text is not null),
e as (select doc_id, generate_subscripts(q, 1) - 1 as unit_no, unnest(q) as unit from p)
select doc_id, unit_no, {_BLOCK.format('unit').replace('{{', '{').replace('}}', '}')} as type, len(string_split({_C.format('unit')}, ' ')) as tokens,
 coalesce(sum(length(unit) + 2) over (partition by doc_id order by unit_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_pos, length(unit) as unit_chars from e""",
    "force_split_chunks": f"""with w as (select doc_id, {_WORDS} as w from documents where text is not null), c as (select doc_id, w, unnest(range(0, ceil(len(w) / 225)::bigint)) as chunk_no from w)
select doc_id, chunk_no, md5(array_to_string(w[chunk_no * 225 + 1 : chunk_no * 225 + 225], ' ')) as chunk_md5 from c""",
    "incremental_pending": """with o as (select * from documents qualify row_number() over (partition by relative_path order by doc_id) = 1),
b as (select relative_path, md5(rtrim(text)) as old from o where updated_at < timestamptz '2025-07-01 00:00:00+00')
select case when old is null then 'new' when old = md5(text) then 'unchanged' else 'changed' end as change, count(*) as n from o left join b using (relative_path) group by 1""",
    "image_positions": r"""with p as (select doc_id, text, string_split_regex(text, '\[IMAGE[^\]]*\]') as q, regexp_extract_all(text, '\[IMAGE[^\]]*\]') as m from documents),
e as (select doc_id, text, q, m, unnest(range(1, len(m) + 1)) as ordinal from p),
o as (select doc_id, text, ordinal, m[ordinal] as mark, (list_sum(list_transform(q[1:ordinal], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:ordinal-1], lambda x: length(x))), 0))::bigint as pos from e)
select doc_id, ordinal, pos as char_in_chunk, length(substring(text, 1, pos)) - length(replace(substring(text, 1, pos), chr(10), '')) + 1 as line_number, length(mark) as marker_length,
 case when trim(regexp_extract(mark, '(?i)\[IMAGE[:\s_]+([^\]]+)\]', 1)) <> '' then trim(regexp_extract(mark, '(?i)\[IMAGE[:\s_]+([^\]]+)\]', 1)) else 'image_' || ordinal end as image_id,
 md5(substring(text, greatest(pos - 60, 0) + 1, least(pos, 60))) as before_md5, md5(substring(text, pos + length(mark) + 1, 60)) as after_md5 from o""",
}
