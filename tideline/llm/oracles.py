"""DuckDB SQL with the same rows as the registered queries, where SQL can express them.

Packing, the classifier and byte-level BPE have none; their tests hold them against an exact round trip, a plain
version, the library with the same vocabulary, and held-out accuracy.
"""

from __future__ import annotations

from . import quality

WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = """
with rows as (select coalesce('c' || cast(conv_id as varchar), 'null') k, conv_id, turn, case when trim(role) <> '' then role else 'unknown' end who, coalesce("text", '') body from conversations),
said as (select distinct k, conv_id, turn, who, body, ((rank() over (partition by k order by turn nulls first, who, body) - 1) // 512)::bigint win from rows),
people as (select distinct k, who perspective from said where who <> 'system'),
parts as (select s.*, perspective, who = perspective own, '<|im_start|>' || case when who = 'system' then 'system' || chr(10) when who = perspective then 'assistant' || chr(10)
    else 'user name=' || replace(who, '<|', '< |') || chr(10) end head, replace(body, '<|', '< |') || '<|im_end|>' tail from said s join people using (k)),
placed as (select *, coalesce(sum(length(head) + length(tail) + 1) over (partition by k, perspective order by win, turn nulls first, who, body rows between unbounded preceding and 1 preceding), 0)::bigint pos from parts)
select conv_id, perspective, win as "window", count(*) n_messages, count(*) filter (own) n_trained, min(pos) "offset",
  string_agg(head || tail || chr(10), '' order by turn nulls first, who, body) rendered,
  coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(tail)), ',' order by pos) filter (own), '') mask
from placed group by k, conv_id, win, perspective
"""

#: Every window of 100 bytes, as hex digits; the first of equal ones by document and place stays.
OP2 = """
with d as (select doc_id, hex(encode(coalesce("text", ''))) h from documents),
dup as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) n from
  (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) g from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) p from d))) where n > 1),
island as (select doc_id, p, sum(apart) over (partition by doc_id order by p) k from
  (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end apart from dup)),
span as (select doc_id, k, min(p) s, max(p) + 100 e from island group by 1, 2),
cut as (select doc_id, count(*) n_spans, sum(e - s)::bigint n_removed, max(e) last, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' order by s) kept from
  (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) b from span) join d using (doc_id) group by 1)
select doc_id, len(h)::bigint // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) kept_sha256
from d left join cut using (doc_id)
"""

OP4 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce("text", ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
reach as (select a id, a other from e union select id, b from reach join e on a = other),
c as (select id, min(other) least from reach group by 1)
select doc_id, coalesce(n, 0) n_shingles, coalesce(least, doc_id) component_id, coalesce(least, doc_id) = doc_id kept
from documents left join n using (doc_id) left join c on id = doc_id
"""

OP5 = """
with tbl as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) order by i) t from range(256) r(i)),
d as (select doc_id, octet_length(encode(coalesce("text", ''))) + 8 size, md5(cast(doc_id as varchar)) h,
  xor(4294967295::bigint, list_reduce([('0x' || x)::bigint for x in regexp_extract_all(hex(encode(coalesce("text", ''))), '..')], lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint)) text_crc32
  from documents, tbl),
scored as (select doc_id, j, -ln((('0x' || substr(md5(j || ':' || doc_id), 1, 13))::bigint + 0.5) / 4503599627370496) score from documents, range(25) r(j)),
best as (select doc_id, arg_min(j, score) filter (j < 24) shard, arg_min(j, score) grown_shard from scored group by 1)
select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'key' law, shard::int shard,
  row_number() over (partition by shard order by ('0x' || substr(h, 1, 2))::int, doc_id, text_crc32, size) - 1 slot, grown_shard::int grown_shard from d join best using (doc_id)
"""

OP6 = f"""
with w as (select doc_id, regexp_extract_all(coalesce("text", ''), '{WORD}') ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from w)),
dup as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) least from win) where least < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) k from dup),
word as (select doc_id, unnest(ws) x, generate_subscripts(ws, 1) k from w),
kept as (select word.doc_id, string_agg(x, ' ' order by word.k) body from word left join gone on gone.doc_id = word.doc_id and gone.k = word.k where gone.k is null group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0) n_removed, sha256(coalesce(body, '')) kept_sha256
from w left join (select doc_id, count(*) n from gone group by 1) using (doc_id) left join kept using (doc_id)
"""

OP10 = """
with recursive v as (select vec_id, label, embedding::double[] x from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len([c for c in embedding if c is null or not isfinite(c)]) = 0 and len([c for c in embedding if c <> 0]) > 0),
e as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
reach as (select a id, a other from e union select id, b from reach join e on a = other),
c as (select id, min(other) least from reach group by 1)
select vec_id, coalesce(n, 0) n_links, coalesce(least, vec_id) component_id, coalesce(least, vec_id) = vec_id kept
from embeddings left join (select a vec_id, count(*) n from e group by 1) using (vec_id) left join c on id = vec_id
"""


def _layered(source: str, layers: list[dict[str, str]]) -> str:
    for layer in layers:
        source = f"(select *, {', '.join(f'{v} as {k}' for k, v in layer.items())} from {source})"
    return source


def _op9() -> str:
    p = range(len(quality.FEATURES))
    symbols = quality.SYMBOLS
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    xs = ", ".join(f"x{i}" for i in p)
    sums = ", ".join(f"{v} as {k}" for k, v in quality.sums_sql().items())
    factors = [f"l{x}" for x in quality.PAIRS]
    rest = [*quality.MOMENTS, *factors, "det"]

    def estimate(rows: str, factor: float, more: str = "") -> str:
        layers = quality.moments_sql(factor) + quality.cholesky_sql()
        return f"select grp{more}, {', '.join(rest)} from {_layered(f'(select grp{more}, {sums} from {rows} group by grp{more})', layers)}"

    def concentrated(name: str, model: str, more: str = "") -> list[str]:
        near = _layered(f"(select * from vec join (select grp{more}, {', '.join(quality.MODEL)} from {model}) using (grp))", quality.distance_sql())
        closest = f"(select * from near_{name} join (select grp{more}, quantile_cont(q, 0.75) q75 from near_{name} group by grp{more}) using (grp{more}) where q <= q75)"
        return [f"near_{name} as materialized (select grp{more}, {xs}, {quality.RANKED_SQL} q from {near})", f"{name} as materialized ({estimate(closest, quality.FACTOR_RAW, more)})"]

    steps, last = concentrated("begun", "starts", ', "start"'), "chosen"
    fall = f"(1 - {quality.FALL})"
    weighed = f"""case when "start" = 0 then det * {fall} else det end"""
    steps.append(f"""chosen as materialized (select grp, {', '.join(rest)} from begun qualify row_number() over (partition by grp order by {weighed}, "start") = 1)""")
    for k in range(quality.STEPS):
        steps += concentrated(f"step{k}", last)
        chosen = ", ".join(f"case when a.det < m.det * {fall} then a.{c} else m.{c} end {c}" for c in rest)
        steps.append(f"model{k} as materialized (select m.grp, {chosen} from {last} m left join step{k} a on a.grp = m.grp)")
        last = f"model{k}"
    near = _layered(f"(select * from vec join (select grp, {', '.join(quality.MODEL)} from {last}) using (grp))", quality.distance_sql())
    steps.append(f"moments as materialized ({estimate(f'(select * from {near} where d2 <= {quality.CHI2_975})', quality.FACTOR_REWEIGHTED)})")
    wider = ", ".join(f"{c} w_{c}" for c in quality.MOMENTS)
    shrunk = ", ".join(f"{v} {k}" for k, v in quality.shrunk_sql().items())
    for level, up, source in (("wide", "all_", "moments"), ("fine", "wide", "shrunk_wide")):
        steps.append(
            f"shrunk_{level} as materialized (select grp, {shrunk} from moments join (select {level} grp, {up} wider, sum(n_rows)::double n_rows from names group by 1, 2) using (grp) "
            f"join (select grp wider, {wider} from {source}) using (wider))"
        )
    fitted = _layered("shrunk_fine", quality.cholesky_sql())
    final = _layered(f"(select * from b left join (select grp fine, {', '.join(quality.MODEL)} from {fitted}) using (fine))", quality.distance_sql())
    return f"""
with d as (select *, coalesce("text", '') body, regexp_extract_all(coalesce("text", ''), '{WORD}') ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) n from g) where n > 1),
rep as (select doc_id, count(*) n from (select distinct doc_id, unnest(range(i, i + 3)) k from twice) group by 1),
ln as (select doc_id, count(*) n_lines, count(*) - count(distinct l) n_dup_lines from (select doc_id, unnest(string_split(body, chr(10))) l from d) where trim(l, {space}) <> '' group by 1),
s as (select doc_id, lang, source, len(ws)::bigint n_words, coalesce(len(array_to_string(ws, '')), 0)::bigint word_chars, (length(body) - length(translate(body, '{symbols}', '')))::bigint n_symbols,
  coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_lines, 0) n_lines, coalesce(n, 0) n_repeat_words from d left join rep using (doc_id) left join ln using (doc_id)),
b as materialized (select *, {quality.BASE_SQL} base_failed, {', '.join(f'{v} {k}' for k, v in quality.vector_sql().items())}, 'w' || coalesce('l' || lang, '') wide, '*' all_,
  'f' || coalesce('l' || lang, '') || '/' || coalesce('s' || source, '') fine from s),
names as materialized (select fine, wide, all_, count(*) n_rows from b where not base_failed group by 1, 2, 3),
vec as materialized (select unnest([fine, wide, all_]) grp, {xs} from b where not base_failed),
med as (select grp, {', '.join(f'quantile_cont(x{i}, 0.5) m{i}' for i in p)} from vec group by 1),
mad as (select grp, {', '.join(f'quantile_cont(abs(x{i} - m{i}), 0.5) a{i}' for i in p)} from vec join med using (grp) group by 1),
plain as ({estimate('vec', 1.0)}),
starts as materialized (select grp, 0 "start", {', '.join(f'm{i}' for i in p)}, {', '.join(f'greatest(1.4826 * a{i}, {float(quality.FLOORS[i])}) l{i}{j}' if i == j else f'0e0 l{i}{j}' for i in p for j in p if j <= i)}
  from med join mad using (grp) union all select grp, 1, {', '.join(quality.MODEL)} from plain),
{', '.join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= {quality.CUTOFF}, false) kept from {final}
"""


def _op8(levels: int = 4) -> str:
    halves = []
    for k in range(levels):
        last = f"t{k - 1}" if k else "units"
        key = f"md5('tree{k}:' || node || ':' || skey || ':' || unit)"
        halves.append(
            f"t{k} as materialized (select skey, unit, node * 2 + (row_number() over (partition by node order by {key}, skey, unit) > ceil(count(*) over (partition by node) / 2))::int node from {last})"
        )
    return f"""
with k as materialized (select doc_id, source, len(regexp_extract_all(coalesce("text", ''), '{WORD}'))::bigint size, coalesce('s' || source, 'n') skey,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 2))::int block, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 3, 15))::bigint pos from documents),
b as materialized (select *, sum(bsize) over (partition by skey order by rank)::bigint cum from (select source, skey, block, sum(size)::bigint bsize,
    row_number() over (partition by skey order by md5('block:' || skey || ':' || block), block) - 1 rank from k group by source, skey, block)),
src as (select source, skey, sum(bsize)::bigint source_size, count(*) nb from b group by 1, 2),
lv as (select *, source_size * 3e0 cap, ([5e0, 2e0, 1e0])[((row_number() over (order by source nulls last)) - 1) % 3 + 1] wt from src),
lw as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / wt, skey rows between unbounded preceding and 1 preceding), 0))
    / sum(wt) over (order by cap / wt, skey rows between current row and unbounded following) lev from lv),
tg as (select *, least(cap, coalesce((max(case when lev <= cap / wt then lev end) over ()) * wt, cap)) target from lw),
g0 as (select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end passes, round(target)::bigint goal from tg),
g1 as (select *, goal - passes * source_size rest from g0),
g2 as (select g1.*, coalesce(last + 1, 0) whole, rest - coalesce(got, 0) remain from g1
  left join (select skey, max(rank) last, max(cum) got from b join g1 using (skey) where cum <= rest and rest > 0 group by 1) using (skey)),
pl as (select skey, pos, remain, sum(psize) over (partition by skey order by pos) cum from
  (select k.skey, pos, remain, sum(size) psize from k join b using (skey, block) join g2 on g2.skey = k.skey where rank = whole and remain > 0 group by 1, 2, 3)),
g3 as (select g2.*, cut, remain - coalesce(got, 0) gap from g2 left join (select skey, max(pos) cut, max(cum) got from pl where cum <= remain group by 1) using (skey)),
ad as (select skey, arg_min({{'b': block, 'p': pos}}, {{'d': abs(psize - gap), 'b': block, 'p': pos}}) a from
  (select k.skey, k.block, pos, gap, sum(size) psize from k join b using (skey, block) join g3 on g3.skey = k.skey
   where gap > 0 and (rank > whole or (rank = whole and (cut is null or pos > cut))) group by 1, 2, 3, 4) where abs(psize - gap) < gap group by 1),
q as materialized (select g3.*, a.b add_block, a.p add_pos, passes * nb + whole + (case when cut is null and a is null then 0 else 1 end) units from g3 left join ad using (skey)),
units as (select skey, unnest(range(units)) unit, 0 node from q),
{", ".join(halves)},
dealt as (select skey, node shard, sum(n) over (partition by skey order by node) - n lo, sum(n) over (partition by skey order by node) hi from (select skey, node, count(*) n from t{levels - 1} group by 1, 2)),
c as (select k.*, rank, nb, units, source_size, target, passes, (rank < whole or (rank = whole and cut is not null and pos <= cut))::int part, coalesce(k.block = add_block and pos = add_pos, false)::int added
  from k join b using (skey, block) join q on q.skey = k.skey),
one as (select doc_id, skey, c, case when c < passes + part then c * nb + rank else units - 1 end unit from (select *, unnest(range(passes + part + added)) c from c)),
sh as (select doc_id, string_agg(shard, ',' order by c) shards from one join dealt on one.skey = dealt.skey and unit >= lo and unit < hi group by 1)
select doc_id, size, source_size, target, size * (passes + part + added) taken, passes + part + added copies, coalesce(shards, '') shards from c left join sh using (doc_id)
"""


def _op11(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} as materialized (select id, p, any_value(x) x, min(d * {entries} + e) m from (select part.id, part.p, e, x, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d "
            f"from part join c{k} on part.p = c{k}.p) group by 1, 2)"
        )
        if k < rounds:
            steps.append(
                f"c{k + 1} as materialized (select p, e, coalesce(y2, y) y from c{k} left join (select p, e, list((s - ((s % n) + n) % n) // n order by i) y2 from "
                f"(select p, m % {entries} e, i, sum(x[i])::bigint s, count(*) n from (select *, unnest(range(1, len(x) + 1)) i from a{k}) group by 1, 2, 3) group by 1, 2) using (p, e))"
            )
    return f"""
with v as materialized (select row_number() over (order by vec_id) id, vec_id, label, list_transform(embedding::double[], lambda c: floor(4096 * c)::bigint) x from embeddings
  where embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
part as materialized (select id, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] x from (select id, x, unnest(range({parts})) p from v)),
c0 as materialized (select p, id - 1 e, x y from part where id <= {entries}),
{', '.join(steps)},
coded as (select id, string_agg(printf('%02x', m % {entries}), '' order by p) code, sum(m // {entries})::bigint error from a{rounds} group by 1),
flat as (select string_agg(c, ',' order by p, e, i) t from (select p, e, i, y[i]::varchar c from (select *, unnest(range(1, len(y) + 1)) i from c{rounds})))
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, sha256(t) codebooks_sha256 from v join coded using (id), flat
"""


TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP13 = f"""
with d as (select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce("text", ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}') ts from documents),
occ as materialized (select lang, source, k, unnest(ts) t from d),
kept as materialized (select lang, t, count(*) n from occ group by 1, 2 having count(distinct k) >= 30),
lv as (select lang, count(*) v, sum(n) total from kept group by 1),
g as materialized (select distinct d.lang, d.source, coalesce(v, 0) v, coalesce(lv.total, 0) lang_total from d left join lv using (lang)),
cnt as materialized (select lang, source, t, count(*) n from occ join kept using (lang, t) group by 1, 2, 3),
gt as (select lang, source, sum(n) total from cnt group by 1, 2),
m as materialized (select g.lang, g.source, t, coalesce(cnt.n, 0) n, 1 + 1000000000::hugeint * (coalesce(cnt.n, 0) + 5) // (coalesce(gt.total, 0) + 5 * v) p, 1 + 1000000000::hugeint * (kept.n + 5) // (lang_total + 5 * v) q
  from g join kept using (lang) left join cnt using (lang, source, t) left join gt using (lang, source)),
pairs as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from m a join m b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by 1, 2, 3),
every as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as "value" from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and item = b.source
  union all select lang, source, 'term', t, (p - q)::bigint from m where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by "value" desc, encode(item)))::int as "rank" from every) where part = 'pair' or "rank" <= 50
"""


ORACLES: dict[str, str] = {
    "op1_chat_perspectives": OP1,
    "op2_suffix_dedup": OP2,
    "op4_minmax_near_dedup": OP4,
    "op5_rendezvous_shards": OP5,
    "op6_substring_dedup": OP6,
    "op8_mix_sources": _op8(),
    "op9_quality_rules": _op9(),
    "op10_covertree_near_dedup": OP10,
    "op11_gnat_vector_codes": _op11(),
    "op13_source_divergence": OP13,
}
