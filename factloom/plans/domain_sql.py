"""The same results as plans.domain in SQL."""

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _id(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')), '')"


def _date(c: str) -> str:
    return f"case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({c} as date) end"


_REFS = " union all ".join(
    f"select '{s}.{c}' as ref_field, package_id, {own} as record_id, '{t}' as target, unnest({c}) as id from {s}"
    for s, own, c, t in (
        ("facts", "fact_id", "evidence_ids", "evidence"),
        ("statements", "statement_id", "fact_ids", "facts"),
        ("statements", "statement_id", "rule_ids", "legal_rules"),
        ("statements", "statement_id", "calculation_ids", "calculations"),
    )
)
_TARGETS = " union all ".join(
    f"select '{t}' as target, package_id, {_id(own)} as key, min(recorded_at) as at, min(deleted_at) as until from {t} group by all"
    for t, own in (("evidence", "evidence_id"), ("facts", "fact_id"), ("legal_rules", "rule_id"), ("calculations", "calculation_id"))
)
_ORPHANS = f"""
with refs as (select distinct ref_field, package_id, record_id, target, {_id('id')} as key from ({_REFS})),
times as (
  select 'facts' as source, package_id, fact_id as record_id, min(recorded_at) as at from facts group by all
  union all select 'statements', package_id, statement_id, min(recorded_at) from statements group by all),
targets as ({_TARGETS}),
cases as (
  select r.ref_field, r.record_id, r.key as ref_id, x.at,
    unnest(case when t.key is null then ['missing'] else list_filter([case when t.at > x.at then 'late' end, case when t.until <= x.at then 'deleted' end], lambda k: k is not null) end) as orphan_kind
  from refs r join times x on x.source = split_part(r.ref_field, '.', 1) and x.package_id is not distinct from r.package_id and x.record_id = r.record_id
  left join targets t on t.target = r.target and t.package_id = r.package_id and t.key = r.key
  where r.key is not null)
"""
_LATEST = """
latest as (select snapshot_no, raw_id, lower(content_sha256) as h, size_bytes as n from raw_files
  qualify row_number() over (partition by snapshot_no, raw_id order by delivered_at desc, lower(content_sha256) desc, size_bytes desc) = 1),
pairs as (select * from (select snapshot_no as cur, lag(snapshot_no) over (order by snapshot_no) as prev from (select distinct snapshot_no from raw_files)) where prev is not null),
changes as (
  select p.cur as snapshot_no, coalesce(a.raw_id, b.raw_id) as raw_id, case when b.raw_id is null then 'added' when a.raw_id is null then 'removed' else 'changed' end as change_kind
  from (select p.cur, l.* from pairs p join latest l on l.snapshot_no = p.cur) a
  full join (select p.cur, l.* from pairs p join latest l on l.snapshot_no = p.prev) b on a.cur = b.cur and a.raw_id = b.raw_id
  join pairs p on p.cur = coalesce(a.cur, b.cur)
  where a.raw_id is null or b.raw_id is null or a.h is distinct from b.h or a.n is distinct from b.n)
"""
_TREE = f"""
with recursive nodes as (select distinct {_id('rule_id')} as node from legal_rules where {_id('rule_id')} is not null),
edges as (select c.node, min(p) as parent from (select {_id('rule_id')} as p, {_id('x')} as child from (select rule_id, unnest(supersedes) as x from legal_rules)) e join nodes c on c.node = e.child group by all),
tree as (
  select node, node as root, 0 as depth, [node] as path from nodes where node not in (select node from edges)
  union all select e.node, t.root, t.depth + 1, list_append(t.path, e.node) from tree t join edges e on e.parent = t.node)
"""
SQL = {
    "p1_found": _ORPHANS + "select distinct ref_field, record_id, ref_id, orphan_kind from cases",
    "p1_by_period": _ORPHANS + "select ref_field, strftime(cases.at at time zone 'UTC', '%Y-%m') as period, orphan_kind, count(*) as orphans from cases group by all",
    "p2_found": "with " + _LATEST + "select snapshot_no, raw_id, change_kind from changes",
    "p2_counts": "with " + _LATEST + "select snapshot_no, change_kind, count(*) as n from changes group by all",
    "p3_found": _TREE + "select n.node as rule_id, coalesce(t.root, 'CYCLE') as root_rule_id, coalesce(t.depth, -1)::int as depth from nodes n left join tree t using (node)",
    "p3_paths": _TREE + "select n.node as rule_id, coalesce(array_to_string(t.path, '/'), '') as path from nodes n left join tree t using (node)",
    "p3_descendants": _TREE + "select a as rule_id, node as descendant_id, (depth - list_position(path, a) + 1)::int as distance from (select node, depth, path, unnest(path) as a from tree) where a <> node",
    "p4_found": f"""
with last as (select document_id, effective_from_candidate as a, effective_to_candidate as b from legal_version
  qualify row_number() over (partition by version_id order by revision_no desc, recorded_at desc) = 1),
d as (select document_id, {_date('a')} as f, b is null as open, case when b is null then date '9999-12-31' else {_date('b')} end as t from last),
v as (select * from d where f is not null and t is not null and f <= t),
o as (select *, max(t) over (partition by document_id order by f, t rows between unbounded preceding and 1 preceding) as reach from v),
g as (select *, sum(case when reach is null or f > reach + 1 then 1 else 0 end) over (partition by document_id order by f, t) as run from o),
p as (select document_id, run, min(f) as f, max(t) as t, bool_or(open) as open from g group by all),
q as (select *, lag(t) over (partition by document_id order by f) as before from p)
select document_id, 'period' as span_kind, strftime(f, '%Y-%m-%d') as span_from, case when open then 'open' else strftime(t, '%Y-%m-%d') end as span_to from q
union all select document_id, 'gap', strftime(before + 1, '%Y-%m-%d'), strftime(f - 1, '%Y-%m-%d') from q where before is not null""",
    "p5_found": f"""
with e as (select distinct selection_id, document_id, {_date('event_date')} as d, selected_at from historical_selection),
k as (select e.selection_id, e.d, v.* from e join legal_version v on v.document_id = e.document_id and v.recorded_at <= e.selected_at where e.d is not null
  qualify row_number() over (partition by e.selection_id, v.version_id order by v.revision_no desc, v.recorded_at desc) = 1),
w as (select *, {_date('effective_from_candidate')} as f, case when effective_to_candidate is null then date '9999-12-31' else {_date('effective_to_candidate')} end as t from k)
select selection_id, version_id, revision_no from w where f is not null and t is not null and f <= t and d between f and t""",
}
