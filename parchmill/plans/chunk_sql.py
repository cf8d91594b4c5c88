"""SQL of the chunking strategies: greedy packing and bounds as recursive queries, for the comparison with DuckDB."""

from __future__ import annotations

BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '{BLANK}+'), lambda w: w <> '')"


DOCUMENTS = "docs as (select doc_id, [0] as k, text from documents where text is not null)"


def pack(name: str, source: str, target: int) -> str:
    """name(doc_id, k, no, piece): sentences of source(doc_id, k, text) packed up to target words."""
    text = trimmed("text")
    return rf"""{name}_s as (select doc_id, k, list_filter(string_split(regexp_replace({text}, '([.!?]){BLANK}+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as s from {source}),
{name}_n as (select doc_id, k, s, list_transform(s, lambda x: len({words('x')})) as n from {name}_s where len(s) > 0),
{name}_g as (select doc_id, k, 1 as i, 1 as g, n[1] as size from {name}_n union all
 select p.doc_id, p.k, i + 1, case when size + n[i + 1] > {target} then g + 1 else g end, case when size + n[i + 1] > {target} then n[i + 1] else size + n[i + 1] end
 from {name}_g q join {name}_n p on p.doc_id = q.doc_id and p.k = q.k where i < len(n)),
{name} as (select q.doc_id, q.k, g as no, string_agg(s[i], ' ' order by i) as piece from {name}_g q join {name}_n p on p.doc_id = q.doc_id and p.k = q.k group by 1, 2, 3)"""


def bound(name: str, source: str, least: int = 150, most: int = 300) -> str:
    """name(doc_id, k, no, chunk): pieces of source(doc_id, k, no, piece) joined up to the least and cut at the most."""
    return rf"""{name}_r as (select doc_id, k, piece, len({words('piece')}) as n, row_number() over (partition by doc_id, k order by no) as i from {source}),
{name}_f as (select doc_id, k, i, piece, n, 1 as run, n as size from {name}_r where i = 1 union all
 select r.doc_id, r.k, r.i, r.piece, r.n, case when f.size < {least} then f.run else f.run + 1 end, case when f.size < {least} then f.size + r.n else r.n end
 from {name}_f f join {name}_r r on r.doc_id = f.doc_id and r.k = f.k and r.i = f.i + 1),
{name}_t as (select doc_id, k, run, sum(n) as n, string_agg(piece, ' ' order by i) as piece from {name}_f group by 1, 2, 3),
{name}_l as (select doc_id, k, case when n < {least} and run > 1 and run = max(run) over (partition by doc_id, k) then run - 1 else run end as run, run as own, piece from {name}_t),
{name}_j as (select doc_id, k, run, {trimmed("string_agg(piece, ' ' order by own)")} as piece from {name}_l group by 1, 2, 3),
{name}_w as (select doc_id, k, run, piece, {words('piece')} as w from {name}_j),
{name}_c as (select doc_id, k, run, 0 as cut, piece as chunk from {name}_w where len(w) <= {most} union all
 select doc_id, k, run, cut, array_to_string(w[cut * {most} + 1 : cut * {most} + {most}], ' ') from (select *, unnest(range(0, ceil(len(w) / {most})::bigint)) as cut from {name}_w where len(w) > {most})),
{name} as (select doc_id, k, row_number() over (partition by doc_id, k order by run, cut) - 1 as no, chunk from {name}_c where {trimmed('chunk')} <> '')"""


def _blocks(end: str) -> str:
    return f"list_filter(list_transform(string_split(text, {end}), lambda x: {trimmed('x')}), lambda x: x <> '')"


def sentences(target: int) -> str:
    return f"with recursive {DOCUMENTS}, {pack('a', 'docs', target)}, {bound('b', 'a')} select doc_id, no as chunk_no, chunk from b"


def paragraphs() -> str:
    return f"""with recursive {DOCUMENTS}, p as (select doc_id, {_blocks("chr(10) || chr(10)")} as two, {_blocks("chr(10)")} as one from docs),
u as (select doc_id, case when len(two) > 1 then two else one end as q from p), e as (select doc_id, [generate_subscripts(q, 1)] as k, unnest(q) as text from u),
big as (select * from e where len({words('text')}) > 300), {pack('a', 'big', 300)}, {bound('b', 'a')},
every as (select doc_id, [0] as k, row_number() over (partition by doc_id order by k, no) as no, piece from
 (select doc_id, k, 0 as no, text as piece from e where len({words('text')}) <= 300 union all select doc_id, k, no, chunk from b)),
{bound('z', 'every')} select doc_id, no as chunk_no, chunk from z"""


def lines_bounded() -> str:
    return f"""with recursive {DOCUMENTS}, every as (select doc_id, [0] as k, generate_subscripts(q, 1) as no, unnest(q) as piece from (select doc_id, {_blocks("chr(10)")} as q from docs)),
{bound('z', 'every')} select doc_id, no as chunk_no, md5(chunk) as chunk_md5 from z"""
