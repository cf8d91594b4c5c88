"""Operators on literal rows and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.operators import assembly, chat, chunking, pairing, profile, quality, retrieval, tables, vectors
from parchmill.plans.pages import plain_scorer
from parchmill.sinks import files as sinks

GOOD = "This is a perfectly useful page with more than ten meaningful words inside, surely enough."


def test_dispositions_keep_the_rule_order(spark):
    rows = [(1, "short", False), (2, GOOD, False), (3, GOOD.upper() + "  ", False), (4, None, True), (5, "", True), (6, "https://example.org/" + "x" * 60, False), (7, None, False), (8, GOOD, None)]
    df = spark.createDataFrame(rows, "id int, text string, has_images boolean")
    got = {r.id: (r.disposition, r.original) for r in quality.dispositions(df, "text", "id", "has_images").collect()}
    assert got == {1: ("useless", None), 2: ("kept", None), 3: ("duplicate", 2), 4: ("kept_with_images", None), 5: ("duplicate", 4), 6: ("useless", None), 7: ("useless", None), 8: ("duplicate", 2)}


def test_dispositions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string, has_images boolean")
    assert quality.disposition_counts(quality.dispositions(df, "text", "id", "has_images")).count() == 0


def test_url_only_needs_words(spark):
    urls = " ".join(f"https://example.org/{i}" for i in range(20))
    df = spark.createDataFrame([(1, urls)], "id int, text string")
    assert quality.dispositions(df, "text", "id").first().disposition == "url_only"


def test_global_rank_is_dense_and_ordered(spark):
    rows = [(i % 7, i) for i in range(500)]
    got = profile.global_rank(spark.createDataFrame(rows, "a int, b int").repartition(5), "a", "b").orderBy("a", "b").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))


def test_index_percentile_is_not_the_discrete_one(spark):
    df = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4)], "v int, k int")
    assert {r.p: r.value for r in profile.index_percentiles(df, "v", "k", (50,)).collect()} == {50: 30}


def test_running_total_with_one_hot_key(spark):
    rows = [("hot", i, 1) for i in range(300)] + [(None, i, 2) for i in range(20)] + [("b", 0, None)]
    got = profile.running_total(spark.createDataFrame(rows, "k string, i int, v int").repartition(6), ["k"], ["i"], "v").collect()
    assert all(r.running_total == (r.i + 1) * (1 if r.k == "hot" else 2) for r in got if r.k != "b") and len(got) == 321


def test_sections_of_titles_in_a_row(spark):
    df = spark.createDataFrame([(1, "# A\ntext\n# B\n# C\nmore\nPLAIN TITLE\nend"), (2, ""), (3, None)], "id int, t string")
    got = [(r.id, r.title, r.content, r.start_pos) for r in chunking.sections(df, "id", "t").orderBy("id", "section_no").collect()]
    assert got == [(1, "", "# A\ntext", 0), (1, "# B", "# C\nmore", 9), (1, "PLAIN TITLE", "end", 22), (2, "", "", 0)]


def test_bounded_merges_and_cuts():
    w = lambda n: " ".join(["w"] * n)
    sizes = lambda x: [len(p.split()) for p in chunking.bounded(x)]
    assert sizes([w(100), w(100), w(700), w(10)]) == [200, 300, 300, 110]
    assert sizes([w(10)]) == [10] and sizes([]) == [] and sizes([""]) == []


@pytest.mark.parametrize("strategy", [*chunking.STRATEGIES, "unknown"])
def test_strategies_keep_the_words(strategy):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(30))
    pieces = chunking.apply_strategy(text, strategy)
    assert all(len(p.split()) <= chunking.MOST for p in pieces)
    words = [w for p in pieces for w in p.split()]
    if strategy == "recursive_character":
        assert set(words) == set(text.split())
    else:
        assert words == text.split()


def test_rechunk_levels(spark):
    text = " ".join(f"tok{i} of it" for i in range(400)) + "."
    df = spark.createDataFrame([(1, text), (2, "[IMAGE: a]"), (3, None), (4, "")], "id int, t string")
    kept = chunking.rechunk(df, "id", "t", lambda chunk, original: F.when(F.length(chunk) > 900, 0.2).otherwise(0.9))
    rows = kept.collect()
    assert {r.id for r in rows} == {1} and {r.status for r in rows} <= {"accepted", "accepted_retry_depth_1", "accepted_retry_depth_2", "accepted_retry_depth_3", "accepted_max_depth", "accepted_empty_sub"}
    zero = chunking.rechunk(df, "id", "t", lambda chunk, original: F.lit(0.0)).collect()
    assert {r.status for r in zero} == {"accepted_empty_sub"} and all(r.is_zero_score for r in zero)
    assert chunking.rechunk(df, "id", "t", lambda chunk, original: F.lit(None).cast("double")).count() == 0
    n = chunking.numbered(kept, first=11).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in n] == list(range(11, 11 + len(n)))
    assert chunking.rechunk(df, "id", "t", plain_scorer).count() > 0


def test_semantic_chunks_carry_the_last_unit():
    unit = lambda k: " ".join(f"u{k}w{i}" for i in range(250))
    out = chunking.pack_units("\n\n".join(unit(k) for k in range(4)))
    assert [c[0].split()[0] for c in out] == ["u0w0", "u1w0", "u2w0"] and out[1][0].startswith(unit(1))


def test_companions_and_changes(spark):
    t = spark.createDataFrame([("d", "a", "a.txt"), ("d", "b", "b.txt")], "dir string, stem string, path string")
    j = spark.createDataFrame([("d", "a", "a.json"), ("d", "c", "c.json"), ("d", "a", "a.json")], "dir string, stem string, path string")
    assert {r.path: r.companion for r in pairing.with_companion(t, j, ["dir", "stem"], "path").collect()} == {"a.txt": "a.json", "b.txt": None}
    assert [r.path for r in pairing.standalone(j, t, ["dir", "stem"]).collect()] == ["c.json"]
    now, before = (spark.createDataFrame(x, "k string, d string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9")]))
    assert {r.k: r.change for r in pairing.changes(now, before, "k", "d").collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.k for r in pairing.pending(now, before, "k", "d").collect()} == {"b", "c"}
    assert sorted((r.k, r.d) for r in pairing.replaced(before, now.filter("k = 'b'"), "k").collect()) == [("a", "1"), ("b", "2")]
    every, fresh = pairing.memoised(now.select("k"), before, "k", lambda m: m.select("k", F.lit("new").alias("d")))
    assert {r.k: r.d for r in every.collect()} == {"a": "1", "b": "9", "c": "new"} and fresh.count() == 1


def test_chunk_files_and_their_metadata(spark):
    f = spark.createDataFrame([("x", "--- Chunk 1 [s=a] ---\nOne\n--- Chunk 2 ---\nTwo\n---\n"), ("y", " whole "), ("z", "loose")], "f string, t string")
    texts = pairing.chunk_texts(f, "f", "t")
    meta = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 7), ("z", 8), ("z", 9)], "file string, chunk_id long")
    assert sorted((r.file, r.chunk_id, r.text) for r in pairing.match_texts(meta, texts).collect()) == [("x", 1, "One"), ("x", 2, "Two"), ("y", 7, "whole")]


def test_table_rows_and_images(spark):
    page = "<table><tr><th>a</th><th>b;c</th></tr><tr><td>1</td><td>2</td></tr></table>"
    rows = tables.table_rows(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, h string"), "id", "h")
    assert [(r.table_no, r.row_no, r.cells) for r in rows.orderBy("row_no").collect()] == [(1, 0, ["a", "b;c"]), (1, 1, ["1", "2"])]
    assert [r[0] for r in rows.orderBy("row_no").select(sinks.csv_line(F.col("cells"))).collect()] == ['a;"b;c"', "1;2"]
    cells = spark.createDataFrame([(1, 1, "a", True), (1, 1, "b", False), (1, 2, "c", False), (2, 1, "x", False), (2, 2, "y", False)], "t int, r int, c string, h boolean")
    assert [r.t for r in tables.valid_tables(cells, ["t"], "r", "c", "h").collect()] == [1]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(999, None)], "vec_id long, embedding array<float>").repartition(4)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u.astype(np.float64) @ u.T.astype(np.float64), 6)
    np.fill_diagonal(s, -9)
    q = df.filter("vec_id % 50 = 0")
    got = {(r.query_id, r["rank"]): r.match_id for r in vectors.top_k(df, q, 4).collect()}
    for i in range(0, 300, 50):
        best = sorted(range(300), key=lambda j: (-s[i, j], j))[:4]
        assert all(abs(s[i, got[i, k + 1]] - s[i, b]) < 2e-6 for k, b in enumerate(best))
    indexed = vectors.indexed_top_k(df, q, 4, vectors.fit_centres(df, lists=8), probes=8).count()
    assert indexed == 24
    assert vectors.top_k(df, df.limit(0), 3).count() == 0


def test_near_pairs_are_those_of_all_rows(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, 8)).astype(np.float32)
    m[30:60] = m[30]  # more copies than any k
    m[60:64] = 0  # like nothing, not even each other
    df = spark.createDataFrame([(i + 1, [float(x) for x in r]) for i, r in enumerate(m)] + [(999, None)], "vec_id long, embedding array<float>").repartition(4)
    n = np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros(m.shape), where=n > 0)
    s = np.round(u @ u.T, 6)
    expected = {(i + 1, j + 1) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.4}
    for rows in (7, 8_192):
        got = vectors.all_near_pairs(df, 0.4, block_rows=rows).collect()
        assert {(r.a, r.b) for r in got} == expected and len(got) == len(expected)


def test_near_duplicate_query_has_all_pairs(spark):
    from helpers import DATA

    from parchmill.plans.search import near_duplicate_pairs

    rows = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding is not None]
    u = np.array([r.embedding for r in rows], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    ids = [r.vec_id for r in rows]
    expected = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(s >= 0.4)) if i < j}
    assert expected and {(r.a, r.b) for r in near_duplicate_pairs(spark, DATA).collect()} == expected


def test_index_recall(spark):
    from helpers import DATA

    from parchmill.plans.search import index_recall

    assert index_recall(spark, DATA).first().recall >= 0.9


def test_bm25_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, t string")
    q = spark.createDataFrame([(1, "B!"), (2, "zzz"), (3, None)], "q int, t string")
    got = retrieval.bm25(d, "id", "t", q, "q", "t", 5).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 1)]


def test_feedback_merge_and_checks(spark):
    ts = "2025-01-0{} 00:00:00"
    rows = [("f1", "m", 4, None, "", None, ts.format(1)), ("f2", "m", None, "helpful", None, "x", ts.format(2)), ("f3", "n", 9, None, None, None, ts.format(1))]
    df = spark.createDataFrame(rows, "feedback_id string, message_id string, rating int, sentiment string, issue_type string, comment string, submitted_at string").withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    merged = {r.message_id: (r.rating, r.sentiment, r.comment) for r in chat.merged_feedback(df).collect()}
    assert merged == {"m": (4, "helpful", "x"), "n": (9, None, None)}
    assert {r.feedback_id: r.error for r in chat.valid_feedback(df).collect()} == {"f1": None, "f2": None, "f3": "rating"}
    assert chat.feedback_summary(df.limit(0)).first()[:] == (0, 0.0, 0, 0, 0.0)
    assert chat.rating_distribution(df.limit(0)).count() == 5


def test_long_conversations_stay_whole(spark, tmp_path):
    from parchmill.plans.chats import conversation_nested

    def stamp(c):
        return F.timestamp_seconds(F.lit(1_735_700_000) + F.col(c))

    m = spark.range(2_503).select(
        F.when(F.col("id") < 2_500, "long").otherwise("short").alias("conversation_id"), F.format_string("m%05d", "id").alias("message_id"), stamp("id").alias("created_at"), F.lit("user").alias("role"), F.lit("x").alias("content"), stamp("id").alias("ingested_at")
    )
    m = m.withColumn("created_at", F.when(F.col("message_id") != "m02499", F.col("created_at")))
    r = spark.range(3).select(F.col("id").cast("string").alias("retrieved_id"), F.lit("m01500").alias("message_id"), F.col("id").cast("int").alias("rank"), F.lit("t").alias("titre"), F.lit("f").alias("source_file"), F.lit(1.0).alias("score"))
    m.repartition(3).write.parquet(f"{tmp_path}/chat_messages.parquet")
    r.write.parquet(f"{tmp_path}/retrieved_chunks.parquet")
    got = {x.conversation_id: x for x in conversation_nested(spark, str(tmp_path)).collect()}
    assert got["long"].n == 2_500 and got["long"].n_sources == 3 and got["short"].n == 3
    assert got["long"].message_ids == ",".join(["m02499", *[f"m{k:05d}" for k in range(2_499)]])
    parts = chat.nested_messages(m, r).select("conversation_id", "part", F.size("messages").alias("n")).collect()
    assert sorted((x.conversation_id, x.part, x.n) for x in parts) == [("long", 0, 1000), ("long", 1, 1000), ("long", 2, 500), ("short", 0, 3)]


def test_chunk_entries(spark):
    long = " ".join(f"word{i} goes here." for i in range(300))
    df = spark.createDataFrame([(1, "short text with [IMAGE: a.png]"), (2, long), (3, None), (4, "  ")], "id int, t string")
    rows = assembly.chunk_entries(df, "id", "t", plain_scorer, first_id=100).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(100, 100 + len(rows))) and {r.id for r in rows} == {1, 2}
    assert (rows[0].status, rows[0].content_type, rows[0].total_chunks, rows[0].low_content) == ("original_untouched", "image_section", 1, True)
    assert all(r.total_chunks == len(rows) - 1 and r.token_count <= 300 for r in rows[1:]) and [r.chunk_start_position for r in rows[1:]] == sorted(r.chunk_start_position for r in rows[1:])
    j = assembly.json_entries(spark.createDataFrame([(1, '{"a": 1}'), (2, "no"), (3, None)], "id int, j string"), "id", "j")
    assert j.count() == 2 and j.filter("raw is null").count() == 1
    kinds = spark.createDataFrame([("page", "1"), ("Blogpost", "2"), ("page", "att3"), ("comment", "4"), (None, "5")], "k string, i string")
    assert [r.i for r in kinds.filter(assembly.is_page(F.col("k"), F.col("i"))).collect()] == ["1", "2"]


def test_all_sources_of_a_message_are_kept(spark):
    rows = [("m", k, f"t{k}", "f", "x") for k in range(1, 32)] + [("m", None, "last", "f", "x"), ("m", 1, "t1", "f", "x"), ("n", 2, None, None, None)]
    got = {r.message_id: r for r in chat.contexts(spark.createDataFrame(rows, "message_id string, rank int, titre string, source_file string, texte string")).collect()}
    assert got["m"].n_sources == 32 and got["m"].context.startswith("[1] t1 (f)\nx\n") and got["m"].context.endswith("[-] last (f)\nx\n") and "[31] t31" in got["m"].context
    assert got["n"].context == "[2]  ()\n\n"


def test_latest_reads_what_is_asked(spark, tmp_path):
    spark.createDataFrame([(1, "t" * 50, 3, 1), (1, "u", 4, 2)], "k int, text string, depth int, at int").write.parquet(str(tmp_path / "x"))
    df = chat.latest(spark.read.parquet(str(tmp_path / "x")), "k", "at", ["depth"])
    assert [tuple(r) for r in df.collect()] == [(1, 4, 2)] and "text:string" not in df._jdf.queryExecution().executedPlan().toString()


def test_hybrid_equals_brute_force(spark):
    from parchmill.functions.udfs import hashed_embedding

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(120)] + ["", "zzz"]
    asked = [" ".join(rng.choice(words, 4)) for _ in range(6)] + ["nothing at all"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    vec = lambda t: [float(x) for x in hashed_embedding(t, 16)]
    dv = spark.createDataFrame([(i, vec(t)) for i, t in enumerate(texts)], "doc_id long, v array<float>")
    qv = spark.createDataFrame([(i, vec(t)) for i, t in enumerate(asked)], "query_id int, v array<float>")
    sparse = retrieval.bm25(docs, "doc_id", "text", queries, "q", "text", None)
    scores = {(r.query_id, r.doc_id): r.score for r in sparse.collect()}
    cos = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-30))
    got = {}
    for r in retrieval.hybrid(dv, qv, sparse, 5, near=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score))
    for q, t in enumerate(asked):
        best = max([s for (a, _), s in scores.items() if a == q], default=1)
        every = sorted((round(0.7 * round(cos(np.array(vec(t)), np.array(vec(x))), 6) + 0.3 * scores.get((q, i), 0) / best, 4) for i, x in enumerate(texts)), reverse=True)[:5]
        assert np.allclose([s for _, s in sorted(got[q])], every, atol=2e-4), q


def test_small_operators(spark):
    c = spark.createDataFrame([("1", "u", "t", False), ("2", "v", "s", False), ("3", "u", "r", True)], "conversation_id string, user_id string, title string, is_deleted boolean").withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    now = F.lit("2025-02-01").cast("timestamp")
    assert [r.conversation_id for r in chat.owned(c, "u").collect()] == ["1"]
    titles = spark.createDataFrame([("1", "new"), ("2", "  "), ("9", "x")], "conversation_id string, title string")
    assert {r.conversation_id: r.title for r in chat.renamed(c, titles, now).collect()} == {"1": "new", "2": "s", "3": "r"}
    assert chat.created(titles.select("conversation_id"), "u", now).filter("not is_deleted and user_id = 'u'").count() == 3
    patch = spark.createDataFrame([("1", "p")], "conversation_id string, title string")
    assert {r.title for r in chat.patched(c, patch, "conversation_id", ["title"]).collect()} == {"p", "s", "r"}
    assert c.filter(chat.equal_ignoring_case(F.col("title"), F.lit("T"))).count() == 1
    kids = spark.createDataFrame([("1", "a"), ("3", "b"), (None, "c")], "conversation_id string, m string")
    assert {r.m for r in pairing.with_descendants(c.filter("is_deleted"), kids, "conversation_id").collect()} == {"b"}
    marks = spark.createDataFrame([("f", "[I]"), ("f", "[J]")], "f string, marker string")
    found = spark.createDataFrame([("f", "[I]", "data"), ("f", "[I]", "data")], "f string, marker string, item string")
    assert {r.marker: r.item for r in pairing.matched_media(marks, found, ["f", "marker"]).collect()} == {"[I]": "data", "[J]": None}
    metas, one, two = (spark.createDataFrame(x, "k string, p string") for x in ([("a", "m"), ("b", "m"), ("c", "m")], [("a", "1")], [("a", "2"), ("b", "2")]))
    assert {r.k: r.text_path for r in pairing.paired_with_fallback(metas, one, two, ["k"], "p").collect()} == {"a": "1", "b": "2"}
    pages = spark.createDataFrame([(1, "<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table>"), (2, "")], "id int, h string")
    assert tables.table_statistics(tables.table_rows(pages, "id", "h"), pages).first()[:] == (1, 1, 2, 2)


def test_media_of_chunks_and_companions(spark):
    entries = spark.createDataFrame([(1, "f", "See [IMAGE: a.png] and [IMAGE: b.png]\n| x | y |\n[TABLE_1]", 100), (2, "g", "| a | b |", 0), (3, "g", None, 0)], "chunk_id long, id string, text string, chunk_start_position int")
    found = spark.createDataFrame([("f", "image", 1, "[IMAGE: a.png]", "A"), ("f", "image", 2, "[IMAGE: a.png]", "again"), ("f", "table", 1, "[TABLE_1]", "T"), ("g", "table", 1, "[TABLE_9]", "no")], "id string, kind string, ordinal int, marker string, item string")
    got = sorted((r.chunk_id, r.kind, r.ordinal, r.marker, r["item"], r.position.char_absolute if r.position else None) for r in assembly.media_details(entries, found).collect())
    assert got == [(1, "image", 1, "[IMAGE: a.png]", "A", 104), (1, "image", 2, "[IMAGE: b.png]", None, 123), (1, "table", 1, "[TABLE_1]", "T", None), (2, "table", 1, "| a | b |", None, None)]


def test_a_judge_is_asked_again_and_never_made_up(spark):
    from parchmill.functions.scoring import final_score, judged

    def ask(original, chunk, calls={}):  # noqa: B006
        assert len(original) <= 1200 and len(chunk) <= 1000
        calls[chunk] = calls.get(chunk, 0) + 1
        if "error" in chunk:
            raise ValueError
        if "twice" in chunk and calls[chunk] < 3:
            return "no scores"
        return '{"completeness": 1, "coherence": 1, "relevance": 1, "boundary": 1, "fid' if "bad" not in chunk else "?"

    rows = [(1, "good one"), (2, "twice"), (3, "bad"), (4, "  "), (5, None), (6, "error"), (7, "x" * 5000)]
    df = spark.createDataFrame(rows, "id int, c string").coalesce(1)
    got = {r.id: r.s for r in df.select("id", judged(ask)(F.col("c"), F.lit("o" * 3000)).alias("s")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: None, 6: None, 7: 1.0} and final_score("none") is None
