"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import url_filter
from .decontamination import op9_decontamination
from .embedding_dedup import op1_embedding_dedup
from .language_id import op2_language_id
from .minhash_dedup import op4_minhash_dedup
from .mixing import op6_mixing
from .pii import op3_pii
from .quality import op10_quality
from .substring_dedup import op7_substring_dedup
from .toxicity import op8_toxicity
from .url_filter import op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}

#: All pairs by cosine, then what links reach.
_OP1 = """
with recursive sized as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null),
whole as (select vec_id, e from sized where len(e) = (select len(e) from sized group by 1 order by count(*) desc, 1 limit 1) and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(e, lambda x: abs(x))) > 0),
links as (select a.vec_id as u, b.vec_id as v from whole a join whole b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select distinct u as root, u as here from links union select r.root, l.v from reach r join links l on l.u = r.here),
least as (select root, min(here) as component_id from reach group by root),
counted as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id)::bigint as component_id, coalesce(vec_id = component_id, true) as kept
from embeddings left join least on root = vec_id left join counted on u = vec_id"""

#: Sweeps over the margins as window sums, until all margins meet their targets within the bound.
_OP6 = """
with recursive docs as (
  select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, coalesce(text, '') as t,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as tokens from documents),
described as (
  select doc_id, source, lang, tokens, case when length(t) = 0 then 'empty' when length(regexp_replace(t, '[^|]', '', 'g')) > length(t) * 0.02 then 'table'
    when length(regexp_replace(t, '[^#$%&*]', '', 'g')) > length(t) * 0.02 then 'symbols' when length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(t) * 0.3 then 'capitals'
    when length(regexp_replace(t, '[^0-9]', '', 'g')) > length(t) * 0.1 then 'records' else 'prose' end as topic from docs),
cells as (select source, lang, topic, sum(tokens)::double as tokens from described group by all having sum(tokens) > 0),
shares as (select source, lang, topic, tokens / sum(tokens) over () as share from cells),
ws as (select source, pow(sum(share), 0.5) / sum(pow(sum(share), 0.5)) over () as want, sum(share) as has from shares group by source),
wl as (select lang, pow(sum(share), 0.7) / sum(pow(sum(share), 0.7)) over () as want, sum(share) as has from shares group by lang),
wt as (select topic, pow(sum(share), 0.9) / sum(pow(sum(share), 0.9)) over () as want, sum(share) as has from shares group by topic),
size as (select least(0.8, 0.98 * (select min(has / want) from (select has, want from ws union all select has, want from wl union all select has, want from wt)))::double as s),
start as (select source, lang, topic, share, ws.want * s as a, wl.want * s as b, wt.want * s as c, s from shares join ws using (source) join wl using (lang) join wt using (topic), size),
sweeps as (
  select 0 as i, source, lang, topic, share, a, b, c, s, share * s as w, share * s as free, 1.0::double as error from start
  union all
  select i, source, lang, topic, share, a, b, c, s, w, free, greatest(
    max(abs(ms / a - 1)) over (), max(abs(ml / b - 1)) over (), max(abs(mt / c - 1)) over ()) as error
  from (select *, sum(w) over (partition by source) as ms, sum(w) over (partition by lang) as ml, sum(w) over (partition by topic) as mt
    from (select i, source, lang, topic, share, a, b, c, s, least(free * c / t, share) as w, free * c / t as free
      from (select *, sum(w) over (partition by topic) as t
        from (select i, source, lang, topic, share, a, b, c, s, w * b / t as w, free * b / t as free
          from (select *, sum(w) over (partition by lang) as t
            from (select i, source, lang, topic, share, a, b, c, s, w * a / t as w, free * a / t as free
              from (select i + 1 as i, source, lang, topic, share, a, b, c, s, w, free, sum(w) over (partition by source) as t from sweeps where error >= 1e-7 and i < 400)))))))),
drawn as (select source, lang, topic, w / share as p from sweeps where i = (select max(i) from sweeps))
select doc_id, source, lang, topic, tokens, round(coalesce(p, s) / s, 6) as weight, round(coalesce(p, s), 6) as prob,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 12))::bigint::double / 281474976710656 < coalesce(p, s) as sampled
from described left join drawn using (source, lang, topic), size"""

#: Exact containment of five-word shingles.
_OP9 = """
with words as (select 'd' as kind, doc_id as id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') as w from documents where text is not null
  union all select 'i', item_id, regexp_extract_all(lower(min(text)), '[a-z0-9\\x{80}-\\x{10FFFF}]+') from benchmark where item_id is not null and text is not null group by item_id),
shingles as (select distinct kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where len(w) > 0),
items as (select id as item_id, s, count(*) over (partition by id) as n from shingles where kind = 'i')
select d.id as doc_id, item_id, count(*) as n_found, any_value(n) as n_item, count(*) / any_value(n)::double as containment
from items join shingles d on d.kind = 'd' and d.s = items.s group by all having count(*) >= 0.8 * any_value(n)"""

#: All pairs of distinct texts by the shingles that they share, each occurrence of a shingle one of its own, then what links reach.
_OP4 = """
with recursive words as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') as w from documents),
classes as materialized (select w, min(doc_id) as class_id from words where len(w) > 0 group by w),
shingles as (select class_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5_number(array_to_string(w[i:i + 4], ' ')))) as s from classes),
regions as materialized (select class_id, s, row_number() over (partition by class_id, s) as nth from shingles),
sizes as materialized (select class_id, count(*) as n from regions group by class_id),
shared as (select a.class_id as u, b.class_id as v, count(*) as same from regions a join regions b on a.s = b.s and a.nth = b.nth and a.class_id <> b.class_id group by all),
links as materialized (select u, v from shared join sizes x on x.class_id = u join sizes y on y.class_id = v where same / (x.n + y.n - same)::double >= 0.8),
reach as (select distinct u as root, u as here from links union select r.root, l.v from reach r join links l on l.u = r.here),
least as (select root, min(here) as component_id from reach group by root)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(component_id, class_id, doc_id) as component_id, doc_id = coalesce(component_id, class_id, doc_id) as kept
from words left join classes using (w) left join least on root = class_id"""


def _op5_sql() -> str:
    """The template tree level by level: variables first from the host on, then alike siblings from the deepest level up."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    pick = lambda f: "case " + " ".join(f"when {fits(h, p)} then '{f(v, h, p)}'" for v, h, p in rules) + " end"
    depth = url_filter.DEPTH
    out = rf"""
with pages_at as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) as path from pages),
cut as (select *, {pick(lambda v, h, p: h + p)} as rule, {pick(lambda v, h, p: v)} as ruled, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from pages_at),
shaped as (select *, list_transform(parts[1:{depth}], lambda x: case when regexp_full_match(x, '[0-9]+') then '{{n}}' when regexp_full_match(x, '[0-9]+\.[A-Za-z]{{1,5}}') then '{{n}}' || regexp_extract(x, '(\.[A-Za-z]+)$', 1)
  when regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?') then '{{date}}' when regexp_full_match(x, '[0-9A-Fa-f-]{{8,}}') and regexp_matches(x, '[0-9]') then '{{hex}}'
  when length(x) > 40 or regexp_full_match(x, '[A-Za-z0-9_-]{{12,}}') and regexp_matches(x, '[0-9].*[0-9].*[0-9]') then '{{id}}' else x end) as shape from cut),
urls as materialized (select page_id, host, path, rule, ruled, case when len(parts) > {depth} then list_append(shape, '{{deep}}') else shape end as raw from shaped),
tree0 as materialized (select host, raw, raw as t, count(*) as n, count(ruled) as labelled, count(*) filter (ruled = 'block') as bad from urls group by host, raw)"""
    now = 0

    def star(level: int, mark: str) -> str:
        return f"list_concat(list_concat(t[1:{level}], ['{mark}']), t[{level + 2}:])" if level else f"list_concat(['{mark}'], t[2:])"

    for level in range(depth + 1):
        above = f"array_to_string(t[1:{level}], '/')" if level else "''"
        out += f""",
wide{level} as materialized (select host, above from (select host, {above} as above, t[{level + 1}] as child, sum(n) as n from tree{now} where len(t) > {level} group by all) group by all having count(*) >= {url_filter.FANOUT} and sum(n) < {url_filter.RARE} * count(*)),
tree{now + 1} as materialized (select tree{now}.host, raw, case when wide{level}.host is not null and len(t) > {level} then {star(level, "*")} else t end as t, n, labelled, bad from tree{now} left join wide{level} on wide{level}.host = tree{now}.host and wide{level}.above = {above})"""
        now += 1
    for level in reversed(range(depth + 1)):
        out += f""",
own{level} as materialized (select host, t, array_to_string({star(level, "{like}")}, '/') as open, sum(labelled)::bigint as labelled, sum(bad)::bigint as bad from tree{now} where len(t) > {level} group by host, t),
pool{level} as (select host, open, sum(labelled)::bigint as of_all, sum(bad) / sum(labelled)::double as share from own{level} group by host, open having count(*) > 1 and sum(labelled) > 0),
like{level} as materialized (select host, t as alike from own{level} join pool{level} using (host, open) where labelled = 0 or abs(bad / greatest(labelled, 1) - share) <= {url_filter.SIMILAR_Z}::double * sqrt(greatest(share * (1 - share), 0.25::double / of_all) / greatest(labelled, 1))),
tree{now + 1} as materialized (select tree{now}.host, raw, case when alike is not null then {star(level, "{like}")} else t end as t, n, labelled, bad from tree{now} left join like{level} on like{level}.host = tree{now}.host and alike = t)"""
        now += 1
    return out + f""",
judged as (select host, array_to_string(t, '/') as template, sum(labelled)::bigint as seen, (sum(bad)::bigint + {url_filter.STRENGTH}::double * (select coalesce((sum(bad) + 1)::double / (sum(labelled) + 2)::double, 0.5) from tree{now})) / (sum(labelled)::bigint + {url_filter.STRENGTH}::double) as purity from tree{now} group by all),
rejected as (select host, raw, template, purity from (select host, raw, array_to_string(t, '/') as template from tree{now}) join judged using (host, template) where seen >= {url_filter.LEAST_LABELLED} and purity >= {url_filter.REJECT_AT})
select page_id, host, path, rule, coalesce(ruled, case when template is not null then 'block' else 'allow' end) as verdict, template, purity from urls left join rejected using (host, raw)"""


#: Every 200-byte string by its digest; texts as hexadecimal digits, two to a byte, cut from pieces of 512 starts.
_OP7 = """
with docs as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
sized as materialized (select r, doc_id, h, length(h) // 2 as n from docs),
pieces as (select r, b, substr(h, 2 * b + 1, 2 * (512 + 199)) as h, least(512, n - 199 - b) as starts from (select r, h, n, unnest(range(0, n - 199, 512)) as b from sized)),
strings as materialized (select r, b + i as i0, md5_number(substr(h, 2 * i + 1, 400)) as k from (select r, b, h, unnest(range(0, starts)) as i from pieces)),
again as (select r, i0 from strings where k in (select k from strings group by k having count(*) > 1)),
begun as (select r, i0, case when i0 - lag(i0) over (partition by r order by i0) <= 200 then 0 else 1 end as new from again),
runs as materialized (select r, min(i0) as lo, max(i0) + 200 as hi from (select r, i0, sum(new) over (partition by r order by i0) as run from begun) group by r, run),
gaps as (select r, coalesce(lag(hi) over (partition by r order by lo), 0) as lo, lo as hi from runs
  union all select r, coalesce(max(hi), 0), n from sized left join runs using (r) group by r, n),
kept as (select r, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) as rest from gaps join sized using (r) group by r),
removed as (select r, sum(hi - lo) as n_removed, count(*) as n_spans from runs group by r)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(rest)) as kept_sha256
from sized join kept using (r) left join removed using (r)"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": _OP1,
    "op4_minhash_dedup": _OP4,
    "op5_url_filter": _op5_sql(),
    "op6_mixing": _OP6,
    "op7_substring_dedup": _OP7,
    "op9_decontamination": _OP9,
}
