"""DuckDB twins of the text operators' queries that SQL can express."""

from __future__ import annotations

# The byte table of CRC-32 (a list of 256), from its polynomial.
CRC_TABLE = """(select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def crc32(byte_list: str, table: str = "t") -> str:
    """Unsigned CRC-32 of a list of bytes."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte_list}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(({x})::varchar))::varchar || ':' || ({x})::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


OP13 = f"""
with recursive crc as {CRC_TABLE},
docs as (
  select row_number() over () as n, doc_id, lang, {_leaf('n_chars')} as leaf,
    case when {crc32("list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)")} % 7 = 0 then {_leaf('n_chars + 1')} else {_leaf('n_chars')} end as given
  from documents, crc),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from docs),
nodes(lang, lvl, pos, h) as (
  select lang, 0, pos, leaf from leaves
  union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over (partition by lang) as c from nodes) where c > 1 group by lang, lvl, pos // 2),
subroots as (
  select lang, h as subroot, lvl as height, row_number() over (order by lang nulls first) - 1 as pos
  from (select *, max(lvl) over (partition by lang) as top from nodes) where lvl = top),
tops(lvl, pos, h) as (
  select 0, pos, subroot from subroots
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as c from tops) where c > 1 group by lvl, pos // 2),
climb(n, lang, lvl, pos, height, proof, h) as (
  select n, l.lang, 0, l.pos, height, '', given from leaves l join subroots s on l.lang is not distinct from s.lang
  union all
  select f.n, f.lang, f.lvl + 1, f.pos // 2, height, proof || coalesce(s.h, ''),
    sha256(case when s.h is null then f.h when f.pos % 2 = 1 then s.h || f.h else f.h || s.h end)
  from climb f left join nodes s on s.lang is not distinct from f.lang and s.lvl = f.lvl and s.pos = xor(f.pos, 1)
  where f.lvl < height),
over(n, lvl, pos, proof, h) as (
  select c.n, 0, s.pos, proof, h from climb c join subroots s on c.lang is not distinct from s.lang where c.lvl = c.height
  union all
  select o.n, o.lvl + 1, o.pos // 2, proof || coalesce(s.h, ''),
    sha256(case when s.h is null then o.h when o.pos % 2 = 1 then s.h || o.h else o.h || s.h end)
  from over o left join tops s on s.lvl = o.lvl and s.pos = xor(o.pos, 1)
  where o.lvl < (select max(lvl) from tops))
select l.doc_id, l.leaf, s.subroot, r.h as root, sha256(o.proof) as proof_sha256, o.h as folded_root, o.h = r.h as verified
from leaves l join subroots s on l.lang is not distinct from s.lang join over o on l.n = o.n,
  (select h from tops where lvl = (select max(lvl) from tops)) r
where o.lvl = (select max(lvl) from tops)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_UTF8 = "list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)"

OP11 = f"""
with crc as {CRC_TABLE},
docs as (select row_number() over () as n, doc_id, {_WORDS} as words from documents),
said as (select n, unnest(words) as w from docs),
goal as (select unnest({_WORDS}) as w from benchmark),
bucket as (select w, {crc32(_UTF8)} % 10000 as b from (select w from said union select w from goal), crc),
source as (select b, count(*) as k from said join bucket using (w) group by b),
target as (select b, count(*) as k from goal join bucket using (w) group by b),
sums as (select (select coalesce(sum(k), 0) from source)::double as s, (select coalesce(sum(k), 0) from target)::double as t),
gain as (
  select source.b, floor(1000 * ln((coalesce(target.k, 0) + 1)::double * (s + 10000) / ((source.k + 1)::double * (t + 10000))))::bigint as g
  from source left join target on source.b = target.b, sums),
weights as (select n, count(*) as n_features, floor(sum(g) / count(*))::bigint as weight from said join bucket using (w) join gain using (b) group by n),
scores as (
  select d.n, doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from docs d left join weights w on d.n = w.n),
ranked as (
  select n, row_number() over (order by score desc, doc_id nulls first) as r, count(*) over () as fit from scores where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 10 * fit // 100 then r end as rank from scores left join ranked using (n)
"""

SQL: dict[str, str] = {"op11_target_sampling": OP11, "op13_merkle_manifest": OP13}
