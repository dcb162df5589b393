"""DuckDB SQL of the queries that SQL can express: plainly, without trees, sketches or blocks."""

from __future__ import annotations

from . import mixing, topk, urls

TOPK = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), queries as (select distinct vec_id, q from v where vec_id % 100 = 0),
scored as (
  select a.vec_id as query_id, a.q, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from queries a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id, q order by score desc, vec_id) as rank from scored) where rank <= {topk.K}
"""


#: Levels of the tree in SQL; deeper segments of these tables are all variable.
LEVELS = 4


def _rule_case(column: int) -> str:
    """Longest rules first; column 1 is the rule, 0 its verdict."""
    whens = []
    for rule in sorted(urls.RULES, key=lambda r: -len(r[1])):
        domain, _, path = rule[1].partition("/")
        whens.append(f"when (host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '/{path}') then '{rule[column]}'")
    return f"case {' '.join(whens)} end"


def url_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    steps = [
        f"""u as (select row_number() over () as n, page_id, coalesce(translate(regexp_extract(url, '{whole}', 1), '{upper}', '{lower}'), '') as host,
                 coalesce(regexp_extract(url, '{whole}', 2), '') as path from pages)""",
        f"l as (select *, {_rule_case(1)} as rule, {_rule_case(0)} as label from u)",
        "t0 as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts, '' as template from l)",
    ]
    for k in range(LEVELS):
        steps += [
            f"c{k} as (select host, template, parts[{k + 1}] as part, count(*) as n from t{k} where len(parts) > {k} group by all)",
            f"""d{k} as (select * from (select *, sum(n) over (partition by host, template) as total from c{k})
                  where n >= {urls.LITERAL_COUNT} and n >= total * {urls.LITERAL_SHARE})""",
            f"""t{k + 1} as (select t.* replace (case when len(parts) > {k} then t.template || '/' || coalesce(d.part, '*') else t.template end as template)
                  from t{k} t left join d{k} d on t.host = d.host and t.template = d.template and parts[{k + 1}] = d.part)""",
        ]
    steps += [
        f"t as (select * replace (template || repeat('/*', greatest(len(parts) - {LEVELS}, 0)) as template) from t{LEVELS})",
        "leaf as (select host, template, count(*) as n, count(label) as labelled, count(*) filter (label = 'block') as blocked from t group by all)",
        """split as (select host, template, n, labelled, blocked, p[i] as literal, array_to_string(p[:i - 1], '/') as prefix, array_to_string(p[i + 1:], '/') as suffix
              from (select *, string_split(template, '/')[2:] as p from leaf), unnest(range(1, len(p) + 1)) r(i) where p[i] <> '*')""",
        f"""branch as (select *, string_agg(distinct suffix, ' ' order by suffix) filter (n >= {urls.MAIN_SHAPE} * nb) over o as shape
              from (select *, sum(n) over (partition by host, prefix, literal) as nb from split) window o as (partition by host, prefix, literal))""",
        "seen as (select *, sum(n) over (partition by host, prefix, shape, suffix) as ns, sum(n) over (partition by host, prefix, shape) as np from branch)",
        "free as (select host, prefix, shape, count(distinct suffix) - 1 as df from branch group by all)",
        f"""alike as (select host, prefix, shape, literal, sum(labelled) as bl, sum(blocked) as bb from seen join free using (host, prefix, shape) group by host, prefix, shape, literal, df
              having sum((n - nb * ns / np) ** 2 / (nb * ns / np)) + max(nb) * (1 - sum(ns) / max(np)) <= df + {urls.SHAPE_ERRORS} * sqrt(2 * df) + 1e-6)""",
        f"""joined as (select host, prefix, shape, literal from (select *, sum(bb) over o / greatest(sum(bl) over o, 1) as share from alike window o as (partition by host, prefix, shape))
              where bl = 0 or abs(bb / bl - share) <= {urls.LABEL_ERRORS} * sqrt(share * (1 - share) / bl) + 1e-12)""",
        "pooled as (select *, sum(labelled) over o as ml, sum(blocked) over o as mb from branch join joined using (host, prefix, shape, literal) window o as (partition by host, prefix, shape, suffix))",
        "best as (select host, template, max({'a': ml::bigint, 'b': mb::bigint}) as m from pooled group by all)",
        f"hosts as (select host, (sum(blocked) + {urls.STRENGTH * urls.PRIOR}::double) / (sum(labelled) + {urls.STRENGTH}::double) as of_host from leaf group by 1)",
        f"""tree as (select host, template, coalesce(m.a, labelled) as labels, (coalesce(m.b, blocked) + {urls.STRENGTH}::double * of_host) / (coalesce(m.a, labelled) + {urls.STRENGTH}::double) as purity
                  from leaf left join best using (host, template) join hosts using (host))""",
    ]
    return f"""with {", ".join(steps)}
      select page_id, t.host, path, rule, coalesce(label, case when labels > 0 and purity >= {urls.REJECT} then 'block' else 'allow' end) as verdict, t.template, purity
      from t join tree on t.host = tree.host and t.template = tree.template"""


_RANKS = (1 << mixing.RANK_BITS) - 1

#: The sample by sorting ranks and running sums.
MIXING = f"""
with w as (select row_number() over () as n, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size from w group by 1),
ordered as (select *, row_number() over (order by source is null, encode(source)) - 1 as k from sources),
weighed as (select *, [{', '.join(map(str, mixing.WEIGHTS))}][k % {len(mixing.WEIGHTS)} + 1] as weight from ordered),
levels as (
  select *, ({mixing.BUDGET} * sum(source_size) over () - {mixing.MAX_REPEAT} * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (o rows between current row and unbounded following) as level, row_number() over o as r
  from weighed window o as (order by source_size / weight, k)
),
first_open as (select min(r) as r, arg_min(level, r) as level from levels where level * weight < {mixing.MAX_REPEAT} * source_size),
targets as (
  select l.source, l.source_size,
    case when f.r is null or l.r < f.r then l.source_size * {float(mixing.MAX_REPEAT)}::double else f.level * l.weight end as target
  from levels l cross join first_open f
),
d as (
  select w.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) as whole,
    coalesce(target / nullif(source_size, 0) - floor(target / nullif(source_size, 0)), 0) as part
  from w join targets t on w.source is not distinct from t.source
),
drawn as (select * from d where part > 0 and size > 0),
bins as (
  select source, length(bin(size)) as b, sum(size) as words, max(part * source_size) as need,
    sum(floor(pow(size, {mixing.POWER}) * {mixing.PULL})::hugeint * size)::double as pull from drawn group by all
),
steps as (
  select source, pow(2.0, b) as top,
    (need - coalesce(sum(words) over (partition by source order by b desc rows between unbounded preceding and 1 preceding), 0))
    / (sum(pull) over (partition by source order by b) / {mixing.PULL}) as f from bins
),
factors as (
  select source, coalesce(max(f) filter (f * pow(top, {mixing.POWER}) <= 1 and f >= 0), max(f) filter (f >= 0), 0) as f from steps group by 1
),
ranked as (
  select d.*, (('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::varchar, '-'), size::varchar, coalesce(d.source, '-'))), 1, 13))::bigint + 0.5)
      / {float(1 << 52)}::double as u, least(greatest(f * pow(size, {mixing.POWER}), 1e-9), 1 - 1e-9) as p
  from drawn d join factors x on d.source is not distinct from x.source
),
odds as (select *, (u / (1 - u)) / (p / (1 - p)) as o from ranked),
ranks as (select n, source, size, part * source_size as need, floor(o / (1 + o) * {_RANKS}::double)::bigint as rank from odds),
sums as (
  select source, rank, sum(size) as words, count(*) as rows, max(need) as need, sum(sum(size)) over (partition by source order by rank) as upto from ranks group by source, rank
),
quota as (
  select source, rank, case when upto < need then rows else least(rows, floor((need - (upto - words)) * rows / words + 0.5)) end as quota from sums where upto - words < need
),
extra as (
  select n from (select r.n, q.quota, row_number() over (partition by r.source, r.rank order by r.n) as k
                 from ranks r join quota q on r.source is not distinct from q.source and r.rank = q.rank) where k <= quota
)
select doc_id, size, source_size, target, ((whole + (extra.n is not null)::int) * size)::bigint as taken from d left join extra on d.n = extra.n
"""

ORACLE_SQL = {"op6_mixing": " ".join(MIXING.split()), "op3_urls": " ".join(url_sql().split()), "op7_topk": " ".join(TOPK.split())}
