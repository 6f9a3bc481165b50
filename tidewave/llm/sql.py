"""Independent DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP5 = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), b as (
  select page_id, regexp_extract(rest, '^[^?#]*') as before from u
), h as (
  select page_id, translate(regexp_extract(before, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(before, length(regexp_extract(before, '^[^/]*')) + 1) as path from b
), r(rhost, rpath, rverdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m as (
  select h.page_id, h.host, h.path, rhost || rpath as rule, rverdict,
         row_number() over (partition by h.page_id, h.host, h.path order by length(rhost || rpath) desc) as place
  from h join r on (h.host = rhost or ends_with(h.host, '.' || rhost)) and starts_with(h.path, rpath)
)
select h.page_id, h.host, h.path, m.rule, coalesce(m.rverdict, 'allow') as verdict
from h left join m on m.page_id = h.page_id and m.host = h.host and m.path = h.path and m.place = 1
"""

# The two engines' regular expressions read \x escapes alike inside brackets.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_ALPHA, _DELTA = "2e-2", "5e-2"
_RULES = (
    ("n_symbols / greatest(n_words, 1)", (0.8, 0.4, 0.2, 0.1, 0.05)),
    ("word_chars / greatest(n_words, 1)", (12.0, 10.0, 9.0, 8.0, 7.0)),
    ("-word_chars / greatest(n_words, 1)", (-2.0, -2.5, -3.0, -3.5, -4.0)),
    ("n_dup_lines / greatest(n_words, 1)", (0.1, 0.05, 0.02, 0.01, 0.005)),
    ("n_repeat_words / greatest(n_words, 1)", (0.2, 0.15, 0.1, 0.05, 0.02)),
    ("-n_words", (-25.0, -30.0, -40.0, -50.0, -60.0)),
)
_CUTS = [(feature, cut) for feature, cuts in _RULES for cut in cuts]
_FIRST = "least(" + ", ".join(f"case when ({feature})::double > {cut}::double then {i} else {len(_CUTS) + 1} end" for i, (feature, cut) in enumerate(_CUTS, 1)) + ")"
# Windows are compared as text, and the binomial tail is summed term by term with log-gamma.
OP3 = rf"""
with w as (
  select doc_id, lang, coalesce(text, '') as text, {_WORDS} as words from documents
), wins as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)
), twice as (
  select doc_id, i from wins qualify count(*) over (partition by doc_id, win) > 1
), rep as (
  select doc_id, count(distinct i + j) as n from twice, range(8) as t(j) group by doc_id
), lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w
), f as (
  select w.doc_id, w.lang, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words
  from w join lines using (doc_id) left join rep using (doc_id)
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f
), good as (
  select b.* from b semi join (select doc_id from labels group by doc_id having min(quality) = 1) using (doc_id) where not base_failed
), tests as (
  select lang, {_FIRST} as first from good where lang is not null
), counts as (
  select lang, step, count(*)::double as n, count(*) filter (first <= step)::double as k from tests, range(1, {len(_CUTS) + 1}) as t(step) group by all
), tails as (
  select lang, step, case when k >= n * {_ALPHA} then 1e0 else (
    select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA}) + (n - i) * ln(1e0 - {_ALPHA}))) from range(k::bigint + 1) as t(i)) end as tail from counts
), passed as (
  select lang, max(step) as step from tails where tail <= {_DELTA} / (select count(distinct lang) from counts) group by lang
)
select doc_id, f.lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_FIRST} > coalesce(passed.step, 0) as kept
from b f left join passed on passed.lang = f.lang
"""

OP6 = r"""
with recursive t as (
  select doc_id, source, lang, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents
), d as (
  select doc_id, source, lang, n_tokens, case when contains(text, ' | ') then 'table' when len(regexp_extract_all(text, '[#*$%&<>]')) * 5 > n_tokens then 'markup'
    when n_tokens < 100 then 'short' when n_tokens < 1000 then 'medium' else 'long' end as topic from t
), c as (
  select coalesce(source, '') as s, coalesce(lang, '') as l, topic as p, sum(n_tokens)::double as tok from d group by all having sum(n_tokens) > 0
), ts as (select s, pow(sum(tok), 5e-1) as x from c group by s), tp as (select p, pow(sum(tok), 7e-1) as x from c group by p),
tl as (select distinct l, case l when 'en' then 55e-2 when 'de' then 15e-2 when 'es' then 15e-2 when 'fr' then 15e-2 else 5e-2 end as x from c),
g as (
  select c.*, ts.x / (select sum(x) from ts) as gs, tl.x / (select sum(x) from tl) as gl, tp.x / (select sum(x) from tp) as gp
  from c join ts using (s) join tl using (l) join tp using (p)
), r as (
  select 0 as it, s, l, p, tok, gs, gl, gp, tok / sum(tok) over () as w from g
  union all
  select it + 1, s, l, p, tok, gs, gl, gp, w2 * gp / sum(w2) over (partition by p) from (
    select *, w1 * gl / sum(w1) over (partition by l) as w2 from (
      select *, w * gs / sum(w) over (partition by s) as w1 from r where it < 120))
), q as (
  select s, l, p, tok, w, w / tok as per from r where it = 120
), o as (
  select *, row_number() over z as place, (sum(tok) over () * 5e-1 - coalesce(sum(tok) over y, 0)) / greatest(sum(w) over () - coalesce(sum(w) over y, 0), 1e-300) as scale
  from q window z as (order by per desc, s, l, p), y as (order by per desc, s, l, p rows between unbounded preceding and 1 preceding)
), b as (
  select arg_min(scale, place) as scale, min(place) as place from o where scale * per <= 1
), e as (
  select o.s, o.l, o.p, o.per, case when b.place is null or o.place < b.place then 1e0 else greatest(0e0, least(1e0, b.scale * o.per)) end as prob from o, b
), f as (
  select d.*, case when n_tokens > 0 then coalesce(e.prob, 0e0) else 0e0 end as pr, coalesce(e.per * n_tokens, 0e0) as we
  from d left join e on coalesce(source, '') = s and coalesce(lang, '') = l and topic = p
)
select doc_id, source, lang, topic, n_tokens, round(we, 9) as weight, round(pr, 6) as prob,
       ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656e0 < pr as kept from f
"""

OP1 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)
), f as (
  select a, b from e union all select b, a from e
), r as (
  select doc_id, doc_id as comp from documents union select f.b, r.comp from r join f on f.a = r.doc_id
), c as (
  select a as doc_id, count(*) as n_links from f group by 1
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.comp as component_id, coalesce(c.n_links, 0)::bigint as n_links
from w left join n using (doc_id) left join c using (doc_id) join (select doc_id, min(comp) as comp from r group by 1) m using (doc_id)
"""

OP11 = r"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), l as (
  select doc_id, i, ls[i] as line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)
), k as (
  select key, max(doc_id) as top from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), r as (
  select l.doc_id, i, line, k.key is not null and l.doc_id <> k.top as dropped from l left join k on k.key = l.key
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (dropped))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256 from r group by doc_id
"""

OP12 = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents
), u as (
  select *, length(text)::bigint as n, [('0x' || substr(h, 1, 8))::bigint, ('0x' || substr(h, 9, 8))::bigint, ('0x' || substr(h, 17, 8))::bigint, ('0x' || substr(h, 25, 8))::bigint] as r from t
), v as (
  select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
         case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end as form from u
), w as (
  select *, substr(text, 1, a) as p, substr(text, a + 1, b - a) as m, substr(text, b + 1) as s from v
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from w
"""

# crc32 bit by bit; a prefix is the list of its turns.
OP13 = r"""
with t as (
  select conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as w
  from conversations where conv_id is not null
), o as (
  select conv_id, list(k order by turn nulls first, md5(k)) as ks, list(w order by turn nulls first, md5(k)) as ws,
         xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 as h
  from t group by conv_id
), c as (
  select o.conv_id, list_concat(coalesce(b.ks, [])[1:least(o.h, 3)], o.ks[o.h + 1:]) as ks, list_concat(coalesce(b.ws, [])[1:least(o.h, 3)], o.ws[o.h + 1:]) as ws
  from o left join o b on b.conv_id = o.conv_id - o.conv_id % 20
), p as (
  select conv_id, len(ks) as turns, d, ks[1:d] as node, ws[d] as w from (select *, unnest(range(0, len(ks) + 1)) as d from c)
), n as (
  select node, d, any_value(w) as w, count(*) as n_convs, min(conv_id) as conv_id, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (turns = d), '')) as ends_sha256 from p group by node, d
), k as (
  select n.node[1:d - 1] as node, count(*) as n_children from n where d > 0 group by 1
), a as (
  select n.*, coalesce(k.n_children, 0) as n_children from n left join k on k.node = n.node
), s as (
  select node[1:e] as node, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * coalesce(w, 0)) as saved from (select *, unnest(range(0, d + 1)) as e from a) group by 1
)
select a.conv_id, a.d::bigint as depth, up.conv_id as parent_conv_id, a.n_convs::bigint as n_convs, a.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, a.ends_sha256
from a join s on s.node = a.node left join a up on a.d > 0 and up.d = a.d - 1 and up.node = a.node[1:a.d - 1]
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": OP1, "op3_quality_rules": OP3, "op5_url_filters": OP5, "op6_mixing": OP6, "op11_line_dedup": OP11, "op12_fill_in_middle": OP12, "op13_prefix_trie": OP13}
