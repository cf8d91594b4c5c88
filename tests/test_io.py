"""Files in, files out, and streams."""

import json

from pyspark.sql import functions as F

from parchmill.sinks import files as sinks
from parchmill.sources import files as sources
from parchmill.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_descriptors_and_texts(spark, tmp_path):
    write(tmp_path / "s/a b.txt", "été")
    write(tmp_path / "s/a b.json", "{}")
    write(tmp_path / "s/t/c.json", '{"images": [{"img_id": 5}, {"marker": "[X]"}], "deep": {"rows_of": [{"headers": 1}]}}')
    write(tmp_path / "d.doc", "MIME-Version: 1.0\nContent-Type: text/html\n\n<p>Hi</p><img src='x/y.png'>")
    write(tmp_path / "l.txt", b"caf\xe9")
    root = str(tmp_path)
    got = {r.relative_path: (r.folder_path, r.stem, r.extension) for r in sources.scan(spark, root).collect()}
    assert got["s/a b.txt"] == ("s", "a b", ".txt") and got["d.doc"] == ("", "d", ".doc") and len(got) == 5
    d = {(r.type, r.relative_path): r.companion for r in sources.descriptors(spark, root).collect()}
    assert d == {("txt", "s/a b.txt"): "s/a b.json", ("txt", "l.txt"): None, ("json", "s/t/c.json"): None}
    t = {r.relative_path: (r.text, r.has_images) for r in sources.texts(sources.scan(spark, root, "*.{txt,doc}")).collect()}
    assert t["l.txt"] == ("café", False) and t["s/a b.txt"][0] == "été" and t["d.doc"] == ("Hi\n\n[IMAGE: y.png]", True)
    raw = spark.createDataFrame([(1, (tmp_path / "s/t/c.json").read_text()), (2, "not json"), (3, None)], "id int, j string")
    m = [(r.kind, r.marker) for r in sources.companion_media(raw, "id", "j").orderBy("kind", "ordinal").collect()]
    assert m == [("image", "[IMAGE_5]"), ("image", "[X]"), ("table", "[TABLE_1]")]


def test_chunk_records_and_log(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps([{"chunk_id": 1, "text": "x"}, {"text": "no id"}]))
    write(tmp_path / "b.json", json.dumps({"chunk_id": 2, "text": "y", "more": 1}))
    assert sorted(r.chunk_id for r in sources.chunk_records(spark, str(tmp_path), "chunk_id long, text string").collect()) == [1, 2]
    write(tmp_path / "p.log", '{"asctime": "2025-01-01 10:00:00,123", "name": "n", "levelname": "INFO", "message": "Search done in 0.25 s"}\n')
    e = sources.read_log(spark, str(tmp_path / "p.log")).first()
    assert e.event.strip() == "Search done in" and e.seconds == 0.25 and e.level == "INFO"


def test_markdown_posts(spark, tmp_path):
    write(tmp_path / "content/a-post.md", "---\ntitle: 'T'\ndate: 2025-01-02\ntags: [x, y]\n---\n# H\nBody *text*")
    write(tmp_path / "content/b/index.md", "no head")
    p = {r.slug: r for r in sources.markdown_posts(spark, str(tmp_path)).collect()}
    assert p["a-post"].title == "T" and p["a-post"].tags == ["x", "y"] and p["a-post"].description == "H Body text" and p["b"].title == "B"
    assert [r.slug for r in sources.posts_in_order(sources.markdown_posts(spark, str(tmp_path))).collect()] == ["a-post", "b"]


def test_csv_tables_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, ["a", "b"]), (1, 1, 1, ["c;d", "e"])], "id int, table_no int, row_no int, cells array<string>")
    sinks.write_tables(rows, str(tmp_path / "t"))
    lines = [x for f in (tmp_path / "t").rglob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert lines == ["\ufeffa;b", '"c;d";e'] and sinks.readable(spark, str(tmp_path / "t"))
    sinks.write_json_report(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "r"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "r").glob("part-*"))) == {"n": 1, "s": "x"}
    chunks = spark.createDataFrame([("f", 2, "b"), ("e", 1, "a")], "folder_path string, chunk_id long, text string")
    assert [r.value.split("\n")[0] for r in sinks.unified_lines(chunks).collect()] == ["==== e (1) ====", "--- Chunk 1 ---", "==== f (1) ====", "--- Chunk 2 ---"]
    sinks.create_if_absent(chunks.limit(0), str(tmp_path / "s"))
    sinks.append(chunks, str(tmp_path / "s"))
    assert sinks.upsert(spark, chunks.filter("chunk_id = 2"), str(tmp_path / "s"), "chunk_id").count() == 2
    assert sinks.samples(chunks, 1).count() == 1


def test_incremental_store_by_stream(spark, tmp_path):
    src, store = tmp_path / "in", incremental.CorpusStore(spark, str(tmp_path / "store"))
    process = lambda f: f.select("path", F.decode("content", "UTF-8").alias("text"))
    write(src / "a.txt", "one")
    write(src / "b.txt", "two")
    run = lambda: store.run(incremental.stream_files(spark, str(src), "*.txt"), str(tmp_path / "cp"), process).awaitTermination()
    run()
    assert sorted(r.text for r in store.read("rows").collect()) == ["one", "two"]
    write(src / "c.txt", "three")
    run()
    assert store.version() == 2 and sorted(r.text for r in store.read("rows").collect()) == ["one", "three", "two"]
    again = spark.read.format("binaryFile").load(str(src)).withColumn("digest", F.md5("content"))
    assert store.apply(again, process) == {"unchanged": 3} and store.version() == 2
    write(src / "a.txt", "ONE")
    changed = spark.read.format("binaryFile").load(str(src)).withColumn("digest", F.md5("content"))
    assert store.apply(changed, process) == {"unchanged": 2, "changed": 1}
    assert sorted(r.text for r in store.read("rows").collect()) == ["ONE", "three", "two"]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, f"2025-01-01 00:{m:02d}:00") for m in (0, 0, 1, 5, 5, 5)], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    batch = {(r.window_start, r.n) for r in incremental.rate_limited(events, "user_id", "ts", 1).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.rate_limited(stream, "user_id", "ts", 1).writeStream.outputMode("update").format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window_start, r.n) for r in spark.table("limited").collect()} == batch and len(batch) == 2


def test_store_writes_what_changed_and_counts_on(spark, tmp_path):
    store = incremental.CorpusStore(spark, str(tmp_path / "s"), "k", "d", "n", ("k",))
    frame = lambda rows: spark.createDataFrame(rows, "k string, d string, modificationTime int")
    process = lambda f: f.select("k", F.upper("d").alias("text"))
    assert store.read("rows") is None and store.next_id() == 1
    assert store.apply(frame([("a", "z", 1), ("a", "x", 2), ("b", "y", 1)]), process) == {"new": 2}
    assert store.apply(frame([("c", "w", 1), ("b", "yy", 3), ("a", "x", 9)]), process) == {"new": 1, "changed": 1, "unchanged": 1}
    rows = lambda: sorted((r.k, r.text, r.n) for r in store.read("rows").collect())
    assert rows() == [("a", "X", 1), ("b", "YY", 3), ("c", "W", 4)] and store.next_id() == 5
    assert spark.read.parquet(str(tmp_path / "s" / "v2" / "rows")).count() == 2
    store.compact()
    assert rows() == [("a", "X", 1), ("b", "YY", 3), ("c", "W", 4)] and store.next_id() == 5 and store.version() == 3 and not (tmp_path / "s" / "v1").exists()
    assert store.apply(frame([("d", "q", 1)]), process) == {"new": 1} and rows()[-1] == ("d", "Q", 5)


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "u")
    sinks.write_upsert(spark, spark.range(40).select("id", F.lit("old").alias("v")), path, "id", parts=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "u").rglob("*.parquet")}
    sinks.write_upsert(spark, spark.createDataFrame([(3, "new"), (99, "new")], "id long, v string"), path, "id", parts=8)
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 41 and got[3] == got[99] == "new" and got[4] == "old"
    assert sum(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items()) >= len(before) - 2


def test_outputs_per_file(spark, tmp_path):
    chunks = spark.createDataFrame([("f/g", "x.txt", 2, "two", 5), ("f/g", "x.txt", 1, "one", 4), ("f", "y.txt", 3, "three", 6)], "folder_path string, source_file string, chunk_id long, text string, tokens int")
    sinks.write_per_file(chunks, str(tmp_path))
    back = spark.read.text(str(tmp_path / "chunks")).filter("source_file = 'x.txt'").collect()
    assert [r.value for r in back if r.value] == ["--- Chunk 1 ---", "one", "--- Chunk 2 ---", "two"]
    meta = spark.read.text(str(tmp_path / "meta")).filter("source_file = 'y.txt'").first()
    assert json.loads(meta.value) == {"chunk_id": 3, "tokens": 6}


def test_timers_of_stale_keys_and_late_events(spark, tmp_path):
    schema = "user_id int, ts timestamp"
    def feed(n, rows):
        spark.createDataFrame([(u, t) for u, t in rows], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    feed(1, [(1, "2025-01-01 00:00:00"), (2, "2025-01-01 00:00:30")])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    def run():
        q = incremental.stale_keys(stream, "user_id", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.user_id, str(r.last_seen)) for r in spark.read.schema("user_id int, last_seen timestamp").parquet(str(tmp_path / "out")).collect())
    assert run() == []
    feed(2, [(2, "2025-01-01 00:20:00"), (1, "2024-12-31 23:00:00")])  # the second is late
    feed(3, [(3, "2025-01-01 00:21:00")])
    got = run()
    assert (1, "2025-01-01 00:00:00") in got and not any(u == 3 for u, _ in got)


def test_markdown_heads_with_a_key_twice(spark, tmp_path):
    write(tmp_path / "content/a.md", "---\ntitle: one\ntitle: two\n---\nBody")
    posts = sources.markdown_posts(spark, str(tmp_path))
    assert posts.first().title == "two" and sources.post_by_slug(posts, "a").count() == 1 and sources.post_by_slug(posts, "zz").count() == 0
