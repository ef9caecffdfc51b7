"""SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
with base as (select doc_id, source, len({WORDS})::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from base group by source),
weighted as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from totals),
ordered as (select *, row_number() over (order by cap / weight, source is null, source) as place from weighted),
levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0.0::double))
    / (sum(weight) over () - coalesce(sum(weight) over (order by place rows between unbounded preceding and 1 preceding), 0.0::double)) as own from ordered),
level as (select arg_min(own, place) as l from levels where own * weight <= cap),
targets as (select source, source_size, case when source_size = 0 then 0.0::double else least(cap, coalesce(l * weight, cap)) end as target from levels left join level on true),
sizes as (select source, size, count(*) as n from base where size > 0 group by all),
squares as (select *, coalesce(sum(n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0)::double as capped,
  (sum((n * size)::hugeint * size) over (partition by source order by size rows unbounded preceding))::double as rest from sizes),
tried as (select s.source, size, source_size, target, (target - 2.0::double * capped) / rest as rate from squares s join targets t on s.source is not distinct from t.source),
rates as (select source, arg_max(rate, size) as rate from tried where rate * size <= 2.0::double and target < source_size * 2.0::double group by source),
parts as (select b.doc_id, b.source, b.size, t.source_size, t.target,
  case when r.rate is null and t.target > 0 then 2.0::double else least(2.0::double, coalesce(r.rate, 0.0::double) * b.size) end as expected
  from base b join targets t on b.source is not distinct from t.source left join rates r on r.source is not distinct from b.source),
missing as (select source, any_value(target) - sum(floor(expected)::bigint * size)::double as missing from parts group by source),
chances as (select *, floor(expected)::bigint as sure, expected - floor(expected) as p,
  (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u from parts),
ranked as (select c.*, m.missing, case when p > 0 then u / (1 - u) / (p / (1 - p)) end as r from chances c join missing m on c.source is not distinct from m.source),
placed as (select *, sum(size) over (partition by source order by r, doc_id, size rows unbounded preceding) as through from ranked where p > 0),
extra as (select *, (through <= missing)::int as extra from placed),
reached as (select source, coalesce(max(case when extra = 1 then through end), 0) as reached from extra group by source),
passed as (select e.* exclude (through, extra), e.missing - reached as open from extra e join reached q on e.source is not distinct from q.source where extra = 0),
placed2 as (select *, sum(size) over (partition by source order by r, doc_id, size rows unbounded preceding) as through from passed where size <= open),
reached2 as (select source, max(through) as reached from placed2 where through <= open group by source),
gap as (select e.*, e.open - coalesce(q.reached, 0) as still from passed e left join reached2 q on e.source is not distinct from q.source
  where not exists (select 1 from placed2 t where t.doc_id = e.doc_id and t.through <= t.open)),
closing as (select source, doc_id, size from gap where abs(still - size) < still
  qualify row_number() over (partition by source order by abs(still - size), r, doc_id, size) = 1),
more as (select doc_id from extra where extra = 1 union all select doc_id from placed2 where through <= open union all select doc_id from closing),
chosen as (select r.doc_id, r.size, r.source_size, r.target, r.sure + (m.doc_id is not null)::int as copies from ranked r left join more m on m.doc_id = r.doc_id)
select doc_id, size, source_size, target, (copies * size)::bigint as taken from chosen
"""

OP3 = """
with rows as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, r.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i]))::bigint as score
  from rows q join rows r on q.vec_id % 50 = 0 and q.vec_id != r.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP4 = rf"""
with docs as (select row_number() over () as row, doc_id, source, text, coalesce(text, '') as body, {WORDS} as words from documents),
lines as (select row, source, text, unnest(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as line from docs),
normal as (select *, regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') as form, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from lines),
limits as (select source, greatest(10, ceil(count(distinct coalesce('x' || text, '')) * 2 / 100)) as most from docs group by source),
counts as (select source, form, count(distinct text) as docs from normal group by source, form),
frequent as (select c.source, c.form from counts c join limits l on c.source is not distinct from l.source where c.docs > l.most),
lost as (select row, sum(n) as lost from normal n join frequent f on n.form = f.form and n.source is not distinct from f.source group by row),
windows as (select row, i, list_slice(words, i, i + 7) as w from (select row, words, unnest(range(1, len(words) - 6)) as i from docs)),
again as (select row, i from windows qualify count(*) over (partition by row, w) > 1),
covered as (select row, count(distinct i + k) as n from again, range(0, 8) t(k) group by row),
base as (
  select d.row, doc_id, len(words)::bigint as n_words, coalesce(length(list_aggregate(words, 'string_agg', '')), 0)::bigint as word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce((select count(*) - count(distinct line) from lines l where l.row = d.row), 0)::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, len(words) - coalesce(lost, 0) as rest
  from docs d left join covered c on c.row = d.row left join lost o on o.row = d.row),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (rest < n_words and (rest < 20 or 100 * rest < 30 * n_words)) as kept from judged
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6 = rf"""
with recursive docs as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [w] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))) end as s from docs),
nodes as (select s, min(doc_id) as node, len(s) as n from sets where len(s) > 0 group by s),
features as (select node, n, unnest(s) as f from nodes),
common as (select a.node as u, b.node as v, a.n as nu, b.n as nv, count(*) as c from features a join features b on a.f = b.f and a.node < b.node group by all),
links as (select u, v from common where 100 * c >= 85 * (nu + nv - c)),
both_ways as (select u, v from links union all select v, u from links),
reach as (select node as start, node as reached from nodes union select r.start, b.v from reach r join both_ways b on b.u = r.reached),
lowest as (select start, min(reached) as component_id from reach group by start)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(component_id, d.doc_id)::bigint as component_id
from sets d left join nodes k on k.s = d.s left join lowest on start = k.node
"""

OP11 = """
with rows as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from rows where vec_id % 100 = 0 qualify row_number() over (partition by vec_id order by label, v) = 1),
scores as (
  select a.vec_id as anchor_id, r.row, r.vec_id, a.label = r.label as same,
    list_sum(list_transform(range(1, greatest(len(a.v), len(r.v)) + 1), lambda i: coalesce(a.v[i], 0) * coalesce(r.v[i], 0)))::bigint as score
  from anchors a join rows r on a.vec_id != r.vec_id or a.label != r.label),
positives as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from scores where same),
pairs as (
  select p.anchor_id, p.place, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.place order by n.score desc, n.vec_id)::int as rank
  from positives p join scores n on p.anchor_id = n.anchor_id and not n.same and p.place <= 5 and 80 * p.score <= 100 * n.score and n.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from pairs where rank <= 5
"""


def _field(value: str) -> str:
    text = f"({value})::varchar"
    return f"coalesce(strlen({text})::varchar || ':' || {text}, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", chars, "text"))) + ")"


# A checksum by bits, a tree level by level, and a proof and a fold by climbing it.
_BIT = "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))"
_BYTE = f"lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), {_BIT}))"
_CRC32 = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), {_BYTE}))"
OP13 = f"""
with recursive docs as (
  select row_number() over () as row, doc_id, coalesce('=' || lang, '') as tree, {_leaf("n_chars")} as leaf, {_leaf("n_chars + 1")} as changed, coalesce({_CRC32} % 7 = 0, false) as altered from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from docs),
nodes as (
  select tree, 0 as level, idx, leaf as hash, count(*) over (partition by tree) as n from leaves
  union all
  select tree, level + 1, idx // 2, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 1) // 2 from nodes where n > 1 group by tree, level, idx // 2),
subroots as (select tree, hash, row_number() over (order by encode(tree)) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, idx, hash, n from subroots
  union all
  select level + 1, idx // 2, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 1) // 2 from tops where n > 1 group by level, idx // 2),
climb as (
  select row, tree, 0 as level, idx, case when altered then changed else leaf end as hash, '' as proof, false as done from leaves
  union all
  select c.row, c.tree, c.level + 1, c.idx // 2, sha256(case when c.idx % 2 = 1 then o.hash || c.hash else c.hash || coalesce(o.hash, '') end), c.proof || coalesce(o.hash, ''), false
  from climb c join nodes s on s.tree = c.tree and s.level = c.level and s.idx = c.idx and s.n > 1
  left join nodes o on o.tree = c.tree and o.level = c.level and o.idx = xor(c.idx, 1)),
reached as (select c.row, c.tree, s.hash as subroot, s.idx, c.hash, c.proof from climb c join nodes t on t.tree = c.tree and t.level = c.level and t.n = 1 join subroots s on s.tree = c.tree),
rise as (
  select row, 0 as level, idx, hash, proof from reached
  union all
  select c.row, c.level + 1, c.idx // 2, sha256(case when c.idx % 2 = 1 then o.hash || c.hash else c.hash || coalesce(o.hash, '') end), c.proof || coalesce(o.hash, '')
  from rise c join tops s on s.level = c.level and s.idx = c.idx and s.n > 1 left join tops o on o.level = c.level and o.idx = xor(c.idx, 1))
select l.doc_id, l.leaf, r.subroot, t.hash as root, sha256(u.proof) as proof_sha256, u.hash as folded_root, u.hash = t.hash as verified
from leaves l join reached r on r.row = l.row join tops t on t.n = 1 join rise u on u.row = l.row and u.level = t.level
"""

SQL = {"op1_pareto_mix": OP1, "op3_impact_ordered_search": OP3, "op4_line_frequency": OP4, "op6_partenum_join": OP6, "op11_angular_negatives": OP11, "op13_merkle_manifest": OP13}
