"""Scalar functions on literal rows: traps of white space, empty values, ranges and marks."""

import base64

import pytest
from pyspark.sql import functions as F

from parchmill.functions import html, media, scoring, udfs
from parchmill.functions import text as tx


def values(spark, column, *rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_words_of_empty_and_blank_text(spark):
    assert values(spark, tx.word_count, "", "  \n", "a", " a  b\tc ", None) == [0, 0, 1, 3, None]
    assert values(spark, tx.long_word_count, "", "ab abc abcd") == [0, 2]


def test_token_estimate_and_content_key(spark):
    assert values(spark, tx.token_estimate, "abc", "abcdefgh", "", None) == [0, 2, 0, None]
    a, b, c = values(spark, tx.content_key, "Same  Text\n", "same text", "other")
    assert a == b != c


def test_human_size_steps(spark):
    assert values(spark, tx.human_size, 0, 1023, 1024, 1536, 1024**2, 1024**3 * 5, kind="long") == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "1.00 MB", "5.00 GB"]


def test_path_parts_of_root_and_deep_files(spark):
    df = spark.createDataFrame([("a.txt",), ("s/t/u.v.Txt",), ("x\\y",)], "p string")
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in tx.path_parts(F.col("p")).items()]).collect()]
    assert rows == [("a.txt", "", "", 0, "root", "a", ".txt"), ("u.v.Txt", "s/t", "t", 2, "s", "u.v", ".txt"), ("y", "x", "x", 1, "x", "y", "")]


def test_boundary_flag(spark):
    assert values(spark, tx.boundary_issue, "Abc", "abc", "  élan", ", x", "12", "", "É") == [False, True, True, True, False, False, False]


def test_block_types(spark):
    rows = ["```x```", "a\n    b", "\n\n\n\n\ntext", "|a|b|\n|c|d|", "- a", "3) x", "see [IMAGE: a]", "plain"]
    assert values(spark, tx.block_type, *rows) == ["code", "code", "prose", "table", "bullet_list", "numbered_list", "image_section", "prose"]
    assert [html_type for html_type in map(__import__("parchmill.operators.chunking", fromlist=["block_type"]).block_type, rows)] == values(spark, tx.block_type, *rows)


def test_titles_and_slugs(spark):
    long = "x" * 70
    assert values(spark, lambda c: tx.title_of(c, "D"), '"Quoted"', " ", None, long) == ["Quoted", "D", "D", "x" * 57 + "..."]
    assert values(spark, tx.slug, "C:\\a\\content\\b\\index.md", "/r/content/c.md") == ["b", "c"]
    assert values(spark, tx.title_from_slug, "a-big--day") == ["A Big Day"]
    assert values(spark, tx.route, "a/b/", "", "//x") == ["/a/b", "/", "/x"]
    assert values(spark, tx.epoch_millis, "1970-01-01T00:00:01Z", "no date") == [1000, None]


def test_shares_of_nothing(spark):
    assert spark.range(1).select(tx.share(F.lit(1), F.lit(0)), tx.percent(F.lit(1), F.lit(8))).first()[:] == (0.0, 12.5)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('x {"completeness":0.9,"coherence":0.95,"relevance":0.9,"boundary":0.9,"fidelity":0.85,"final_score":0.88} y', (0.8875, 0.88, 0.85)),
        ('{"completeness": 0.8, "coherence": 0.9, "relevance": 0.9, "boundary": 0.8, "fidelity": 0.8', (0.83, 0.0, 0.8)),
        ('{"completeness": 1, "coherence": 1, "relevance": 0.5, "boundary": 0.5, "fid', (0.775, 0.0, 0.75)),
        ('{"completeness": 1, "coherence": 1, "relevance": 1, "fidelity": 1', (0.9, 0.0, 1.0)),
        ('{"completeness": 1, "coherence": 1, "rel', None),
        ('{"completeness": 7, "coherence": 1, "relevance": 1, "boundary": 1, "fidelity": -2}', (0.6, 0.0, 0.0)),
        ("nothing", None),
        (None, None),
    ],
)
def test_scores_of_a_judge(spark, raw, expected):
    s = scoring.with_scores(spark.createDataFrame([(raw,)], "x string"), "x").first().scores
    assert (None if s is None else (s.final_score, s.llm_final_score, s.fidelity)) == expected


def test_weights_sum_to_one():
    assert abs(sum(scoring.WEIGHTS.values()) - 1) < 1e-12


def test_media_features_and_true_offsets(spark):
    text = "a\n[IMAGE: x.png] b [IMAGE: x.png]\n| a | b |\n`c`"
    f = values(spark, media.features, text)[0]
    assert (f.total_images, f.total_tables, f.total_code_blocks, f.has_media) == (2, 1, 1, True)
    p = values(spark, lambda c: media.positions(c, r"\[IMAGE[^\]]*\]", F.lit(100)), text, "none", "")
    assert [(x.char_in_chunk, x.char_absolute, x.line_number, x.before) for x in p[0]] == [(2, 102, 2, "a\n"), (19, 119, 2, "a\n[IMAGE: x.png] b ")]
    assert p[1] == p[2] == []


def test_image_data(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 100
    assert values(spark, media.data_type, png, b"\xff\xd8\xff12345", b"GIF89a12", b"RIFF1234WEBP", b"<svg ....", b"BM", None, kind="binary") == ["png", "jpg", "gif", "webp", "svg", None, None]
    src = "data:image/PNG;base64," + base64.b64encode(png).decode()
    u = values(spark, media.data_uri, src, "data:image/png;base64,AAAA", "http://x", "data:image/png;base64,***")
    assert (u[0].extension, len(u[0].data)) == ("png", 108) and u[1:] == [None, None, None]


def test_html_text_tables_and_images():
    page = "<html><script>x</script><p>One&nbsp;&amp;</p><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td><td>3</td></tr></table><img src='p/i.png?x'></html>"
    assert html.visible_text(page) == "One & a b 1 2 3"
    assert html.tables(page) == [[["a", "b"], ["1", "2", "3"]]]
    assert "[TABLE: a, b]" in html.marked_text(page) and "[IMAGE: i.png]" in html.marked_text(page)
    assert html.has_images(page) and not html.has_images("<p>x</p>") and html.has_images("my base64 text")
    ragged = "<table><tr><td>1</td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert html.tables(ragged) == [] and html.tables("<table><tr><td>1</td><td>2</td></tr></table>") == []
    nested = "<table><tr><td>a</td><td><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></td></tr><tr><td>c</td><td>d</td></tr></table>"
    assert [["1", "2"], ["3", "4"]] in html.tables(nested)
    assert html.clean("a&nbsp;b​c\r\n d ﬁ <b>") == "a bc d fi <b>" and html.clean(None) == ""


def test_decoding_and_mime():
    assert udfs.decode("é".encode()) == "é" and udfs.decode(b"caf\xe9 \x93x\x94") == "café “x”" and udfs.decode(None) is None and udfs.decode(b"a\r\nb\rc") == "a\nb\nc"
    mime = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>first</p>\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>second</p>\r\n--B\r\nContent-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--B--\r\n"
    m = udfs.mime_parts(mime)
    assert "first" in m["html"] and m["has_images"] and m["parts"][0]["content_type"] == "image/png"
    assert udfs.mime_parts(b"<p>no mail</p>")["html"] == "<p>no mail</p>"


def test_arrow_functions_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("<p>x</p>",)], "h string")
    assert [r[0] for r in df.select(udfs.visible_text("h")).collect()] == [None, "x"]
    assert len(df.select(udfs.embedder(16)("h").alias("v")).collect()[0].v) == 16
    assert [r[0] for r in df.select(udfs.token_counter(lambda t: 1 // 0)("h")).collect()] == [0, 0]


def test_table_text_follows_its_mark():
    page = "<p>Intro</p><table><tr><th>Code</th><th>Meaning</th></tr><tr><td>7</td><td>secret value</td></tr></table><img src='x/a.png' alt='a plan'><img src='data:image/png;base64,AAAA'><table><tr></tr></table>End"
    assert html.marked_text(page).split() == "Intro [TABLE: Code, Meaning] Code Meaning 7 secret value [IMAGE: a plan] [IMAGE: img_2] [TABLE: table_2] End".split()


def test_lines_of_shown_text():
    assert html.text_lines("<p> one  two </p>\n\n<p>three\tfour</p>\r\n   <script>x</script>") == "one\ntwo\nthree\tfour" and html.text_lines("") == ""


@pytest.mark.parametrize("data", ["é\r\nb\rc".encode(), b"caf\xe9 \x93x\x94", b"", "e\u0301".encode(), b"\x81\xe9", "�".encode() * 2 + b"x" * 500, "�".encode() * 9 + b"x", b"\xa0a"])
def test_decoding_by_expressions_is_the_same(spark, data):
    assert spark.createDataFrame([(data,), (None,)], "c binary").select(udfs.decoded("c")).collect()[0][0] == udfs.decode(data)
