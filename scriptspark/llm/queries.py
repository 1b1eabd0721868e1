"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, bestfit, gif, harmonic, labeller, mixing, passages, prefixtrie, quality, sharding, simhash, transducer, warc


def queries() -> dict:
    found = (
        gif.op1_gif_media, mixing.op2_mixing, labeller.op3_block_labeller, sharding.op4_label_propagation,
        passages.op5_paragraph_minhash, bestfit.op6_best_fit_decreasing, warc.op7_warc_index, quality.op8_host_rules,
        simhash.op9_simhash, harmonic.op10_harmonic_packing, prefixtrie.op11_prefix_trie, alignment.op12_lockstep_alignment, transducer.op13_transducer_counts,
    )
    return {f.__name__: f for f in found}


OP7 = """with p as (select page_id, coalesce(html, '') as h from pages), g as (select h, max(page_id) as k from p where strlen(h) >= 1000 group by h)
select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, case when page_id < k then 'revisit' else 'response' end as record_type, case when page_id < k then k end as refers_to from p left join g using (h)"""

_SPACE = r"[\x20\x09-\x0D]"
OP8 = rf"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
v as (select r, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') as g from (select r, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) as i from w)),
f as (select r, unnest(range(i, i + {quality.WINDOW})) as j from (select *, count(*) over (partition by r, g) as n from v) where n > 1),
h as (select r, count(distinct j) as n_repeat_words from f group by r),
c as (select w.r, doc_id, source, len(ws) as n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join h using (r)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_symbols > {quality.MAX_SYMBOLS}::double * n_words or (n_dup_lines > 1 and n_dup_lines > {quality.MAX_DUP_LINES}::double * n_lines)
  or word_chars < {quality.WORD_LENGTH[0]}::double * n_words or word_chars > {quality.WORD_LENGTH[1]}::double * n_words as soft_failed from c),
o as (select source, count(*)::double as n, count(*) filter (where base_failed or soft_failed)::double as x from j group by source),
m as (select sum(n) as n, sum(x) / sum(n) as mean, sum(x * x / n) as m2, count(*)::double as k from o),
s as (select mean, (m2 / n - mean * mean) - k / n * mean * (1 - mean) as spread from m),
a as (select mean, case when spread > 0 then least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) else 1e6 end as strength from s),
b as (select source, (x + mean * strength) / (n + strength) >= {quality.STRICT_RATE}::double as strict from o, a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (soft_failed and strict) as kept from j join b on j.source is not distinct from b.source"""


OP11 = f"""with recursive bits(i, k, v) as (select i, 0, i from range(256) x(i) union all select i, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as l from bits where k = 8),
o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % {prefixtrie.FAMILY} as base, case when conv_id % {prefixtrie.FAMILY} = 0 then 0 else
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % {prefixtrie.HEADS} end as h
  from (select distinct conv_id from o), crc),
r as (select c.conv_id, 0 as own, pos, role, text from c join o on o.conv_id = c.base where pos < h union all select conv_id, 1, pos, role, text from c join o using (conv_id) where pos >= h),
t as (select conv_id, row_number() over w as d, strlen(text) as size, string_agg(md5(role) || md5(text), '') over w as k from r window w as (partition by conv_id order by own, pos)),
p as (select conv_id, d, size, md5(k) as k from t union all select conv_id, 0, 0, '' from c),
q as (select *, lag(k) over (partition by conv_id order by d) as up, d = max(d) over (partition by conv_id) as ends from p),
n as (select d, k, min(up) as up, min(conv_id) as conv_id, count(*) as n, min(size) as size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends, bool_and(ends) as leaf from q group by d, k),
s as (select q.d, q.k, sum((n - 1) * n.size) as saved, count(*) filter (where leaf) as leaves from n join q on q.conv_id = n.conv_id and q.d <= n.d group by q.d, q.k),
ch as (select d - 1 as d, up as k, count(*) as children from n where d > 0 group by all)
select n.conv_id, n.d as depth, m.conv_id as parent_conv_id, n.n as n_convs, coalesce(children, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, n.ends as ends_sha256
from n join s using (d, k) left join ch using (d, k) left join n m on m.d = n.d - 1 and m.k = n.up"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_index": OP7, "op8_host_rules": OP8, "op11_prefix_trie": OP11}
