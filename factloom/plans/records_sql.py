"""The same results as plans.records in SQL."""

from factloom.plans.domain_sql import _date, _id

_DOC = "(select source || '/' || doc_id || '.txt' as path, text, sha256(text) as h, strlen(text) as n from documents)"

_LINES = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_TYPE = "case when strlen(text) > 8192 and substr(hex(encode(text)), 16385, 1) in ('8','9','A','B') then 'application/octet-stream' else 'text/plain' end"
_REV = "(select distinct version_id, revision_no, recorded_at, document_id, content_sha256, publication_date, effective_from_candidate, effective_to_candidate from legal_version where version_id is not null and revision_no is not null)"
_DEC = "regexp_full_match(coalesce({0}, 'x'), '-?(0|[1-9][0-9]*)(\\.[0-9]+)?')"
_AGAIN = f"""
(select distinct calculation_id, idx, result as declared, i, cast(x as decimal(38,10)) as x, n
 from (select *, unnest(input_values) as x, generate_subscripts(input_values, 1) as i, len(input_values) as n from calculations
       where formula_id = 'SUM_DECIMAL_INPUTS' and calculator_version = '1.0.0' and rounding_policy = 'HALF_UP_2' and list_bool_and([coalesce(regexp_full_match(v, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?'), false) for v in input_values])))"""
_SUMS = f"""
steps as (select calculation_id, idx, declared, n, i, sum(x) over (partition by calculation_id, idx, declared order by i) as s from {_AGAIN}),
again as (select calculation_id, idx, declared, cast(cast(round(max_by(s, i), 2) as decimal(38,2)) as varchar) as recomputed, string_agg(cast(cast(round(s, 2) as decimal(38,2)) as varchar), ';' order by i) as steps from steps group by all)
"""
_KNOWN = " union all ".join(
    f"select '{t}' as t, package_id, idx, {own} as id, recorded_at from {t}"
    for t, own in (("facts", "fact_id"), ("evidence", "evidence_id"), ("calculations", "calculation_id"), ("legal_rules", "rule_id"), ("statements", "statement_id"))
)
_IDS = f"""
rows as ({_KNOWN}),
idf as (
  select package_id as record_id, 'DUPLICATE_ID' as code, '$.' || t || '[' || idx || ']' as path, id as message, 'P1' as severity
  from (select *, row_number() over (partition by t, package_id, id order by idx, recorded_at) as k from rows where package_id is not null and id is not null) where k > 1
  union all select package_id, 'ID_MISSING', '$.' || t || '[' || idx || ']', '', 'P1' from rows where id is null or id = '')
"""
_EDGES = f"edges as (select package_id as g, {_id('rule_id')} as s, {_id('x')} as t from (select package_id, rule_id, unnest(supersedes) as x from legal_rules)), e as (select * from edges where g is not null and s is not null and t is not null)"
_RUNS = """
days as (select user_id as key, cast(epoch_us(date_trunc('day', ts)) // 3600000000 as bigint) as run_at, max_by(event_type, event_id) as t from events where user_id is not null and ts is not null group by all),
checks as (select key, run_at, case t when 'error' then 'UNAVAILABLE_DRAFT_ONLY' when 'signup' then 'CHANGE_DETECTED_REVIEW_REQUIRED' when 'view' then 'STALE_DRAFT_ONLY' else 'UNCHANGED_RESPONSE_BODY_CANDIDATE' end as technical from days),
span as (select min(run_at) as lo, max(run_at) as hi from checks),
grid as (select key, unnest(range(lo, hi + 1, 24)) as run_at from (select distinct key from checks), span),
runs as (select g.key, g.run_at, c.technical, row_number() over (partition by g.key order by g.run_at) as k from grid g left join checks c using (key, run_at)),
st as (
  select key, run_at, k,
    case when technical is null then 'MISSED_DUE_CHECK' else 'CHECKED' end as execution,
    coalesce(technical, 'NOT_CHECKED_MISSED_DRAFT_ONLY') as technical,
    run_at + case when technical is null or technical = 'UNAVAILABLE_DRAFT_ONLY' then 24 else 48 end as next_due,
    [case when technical is null or technical = 'UNAVAILABLE_DRAFT_ONLY' then 1 else 0 end] as recent
  from runs where k = 1
  union all
  select r.key, r.run_at, r.k,
    case when r.technical is not null then 'CHECKED' when r.run_at >= s.next_due then 'MISSED_DUE_CHECK' else 'CARRIED_FORWARD_NOT_DUE' end,
    case when r.technical is not null then r.technical when r.run_at >= s.next_due then 'NOT_CHECKED_MISSED_DRAFT_ONLY' else s.technical end,
    case when r.technical is null and r.run_at < s.next_due then s.next_due else r.run_at + case when r.technical is null or r.technical = 'UNAVAILABLE_DRAFT_ONLY' then 24 else 48 end end,
    case when r.technical is null and r.run_at < s.next_due then s.recent else list_slice(list_append(s.recent, case when r.technical is null or r.technical = 'UNAVAILABLE_DRAFT_ONLY' then 1 else 0 end), -7, -1) end
  from st s join runs r on r.key = s.key and r.k = s.k + 1),
states as (select key, run_at, execution, technical, next_due, cast(list_sum(recent) as int) as failures, list_sum(recent) > 3 as exhausted from st),
raised as (
  select key, run_at, 'LEGAL_SOURCE_' || case technical when 'CHANGE_DETECTED_REVIEW_REQUIRED' then 'CHANGE_DETECTED' when 'UNAVAILABLE_DRAFT_ONLY' then 'CHECK_UNAVAILABLE' when 'STALE_DRAFT_ONLY' then 'CHECK_STALE' else 'CHECK_MISSED' end as code,
    case technical when 'CHANGE_DETECTED_REVIEW_REQUIRED' then 'CRITICAL' when 'STALE_DRAFT_ONLY' then 'HIGH' else 'WARNING' end as severity
  from states where technical <> 'UNCHANGED_RESPONSE_BODY_CANDIDATE'
  union all select key, run_at, 'LEGAL_SOURCE_ERROR_BUDGET_EXHAUSTED', 'HIGH' from states where exhausted)
"""


def _none(c: str) -> str:
    return f"coalesce(len(list_filter({c}, lambda x: {_id('x')} is not null)) < 1, true)"


def _f(table: str, when: str, code: str) -> str:
    return f"select package_id as record_id, '{code}' as code from {table} where {when}"


SQL = {
    "manifest_raw_ids": f"select 'RAW-' || sha256(unhex(hex(encode(path)) || '00' || h)) as raw_id, path as relative_path, sha256(path) as path_sha256, h as content_sha256, n as size_bytes from {_DOC}",
    "manifest_summary": f"select count(*) as file_count, coalesce(sum(n), 0)::bigint as total_bytes from {_DOC}",
    "manifest_limits": f"select unnest(list_filter([case when c > 500 then 'FILE_COUNT_EXCEEDED' end, case when m > 20000 then 'FILE_TOO_LARGE' end], lambda x: x is not null)) as code from (select count(*) as c, max(n) as m from {_DOC})",
    "media_sniff": f"select {_TYPE} as detected_media_type, {_TYPE} <> 'text/plain' as extension_media_type_mismatch, count(*) as files from documents group by all",
    "duplicate_content_members": "select doc_id, min(doc_id) over (partition by text) as class_id, count(*) over (partition by text) as copies from documents qualify copies > 1",
    "duplicate_content_groups": "select sha256(text) as identity_sha256, count(*) as occurrences from documents where text is not null group by all having count(*) > 1",
    "workspace_dedup_summary": f"select sum(c * n)::bigint as logical_bytes, sum(n)::bigint as stored_bytes, count(*) as unique_objects from (select h, count(*) as c, max(n) as n from {_DOC} group by h)",
    "dangling_raw_files": "select distinct package_id, evidence_id, raw_id from evidence e where not exists (select 1 from raw_files r where r.package_id = e.package_id and r.raw_id = e.raw_id)",
    "dangling_refs": "select l_orderkey, count(*) as lines from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by all",
    "duplicate_identifiers": f"with {_IDS} select * from idf",
    "duplicate_values": "select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by all having count(*) > 1",
    "missing_identifiers": f"select fact_id, (pos - 1)::int as pos, id is null as is_null from (select fact_id, unnest(evidence_ids) as id, generate_subscripts(evidence_ids, 1) as pos from facts) where {_id('id')} is null",
    "vocab_violations": "select 'orders' as source, o_orderkey::varchar as id, o_orderstatus as value from orders where o_orderstatus is null or o_orderstatus not in ('F','O') union all select 'facts', fact_id, status from facts where status is null or status not in ('USER_ASSERTED','EVIDENCE_LINKED','DISPUTED')",
    "sha256_shape": "select snapshot_no, raw_id, content_sha256 is null as hash_null from raw_files where content_sha256 is null or not regexp_full_match(lower(content_sha256), '[0-9a-f]{64}')",
    "path_safety": "select count(*) as paths, sum(case when relative_path <> '' and relative_path not like '/%' and not contains(relative_path, chr(92)) and relative_path <> '.' and not list_contains(string_split(relative_path, '/'), '..') then 1 else 0 end)::bigint as relative_path_safe, 0::bigint as up_safe, 0::bigint as root_safe from raw_files",
    "date_interval_invalid": f"""
with v as (select distinct version_id, revision_no, effective_from_candidate as a, effective_to_candidate as b from legal_version),
d as (select *, {_date('a')} as f, {_date('b')} as t from v)
select version_id, revision_no, code from (select *, case when a is null then 'DATE_MISSING' when f is null or (b is not null and t is null) then 'DATE_FORMAT_INVALID' when t < f then 'DATE_INTERVAL_INVALID' end as code from d) where code is not null""",
    "utc_times": "select fact_id, idx, epoch_us(recorded_at) + 48 * 3600000000 as due_us, true as offset_refused from facts",
    "decimal_text_validity": f"""
select calculation_id, count(*) as n_values, sum(({_DEC.format('v')})::int)::bigint as n_decimals, sum((regexp_full_match(coalesce(v, 'x'), '(0|[1-9][0-9]{{0,14}})\\.[0-9]{{2}}'))::int)::bigint as n_amounts
from (select calculation_id, unnest(list_concat([result], coalesce(input_values, []))) as v from calculations) group by all""",
    "sum_decimal_recompute": f"with {_SUMS} select distinct c.calculation_id, c.idx, a.recomputed, a.steps from calculations c left join again a on a.calculation_id = c.calculation_id and a.idx is not distinct from c.idx and a.declared is not distinct from c.result",
    "calc_result_mismatch": f"with {_SUMS} select distinct calculation_id, idx, declared, recomputed from again where declared is distinct from recomputed",
    "value_conflicts": "select l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, count(*) over (partition by l_orderkey) - count(*) over (partition by l_orderkey, l_returnflag) as conflicts from lineitem qualify conflicts > 0",
    "value_conflict_classes": "select snapshot_no, raw_id, count(*) as distinct_values, sum(n)::bigint as n_views, ((sum(n) * sum(n) - sum(n * n)) // 2)::bigint as conflict_pairs from (select snapshot_no, raw_id, lower(content_sha256) as h, count(*) as n from raw_files where snapshot_no is not null and raw_id is not null group by all) group by snapshot_no, raw_id having count(*) > 1",
    "semantic_kind_conflicts": "select user_id, strftime(ts, '%Y-%m-%d') as day, event_type, event_id, count(*) over (partition by user_id, strftime(ts, '%Y-%m-%d')) - count(*) over (partition by user_id, strftime(ts, '%Y-%m-%d'), event_type) as conflicts from events qualify conflicts > 0",
    "timeline_conflicts": """
select a.user_id, a.event_id, 'TIMELINE_ORDER_CONFLICT' as code, count(*) as conflicts from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'purchase' and b.ts < a.ts group by all
union all select a.user_id, a.event_id, 'TERMINATION_AFTER_END', count(*) from events a join events b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'purchase' and b.ts < a.ts group by all
union all select a.user_id, a.event_id, 'TERMINATION_BEFORE_START', count(*) from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'error' and b.ts < a.ts group by all""",
    "changed_keys": f"""
select coalesce(a.version_id, b.version_id) as version_id, case when a.version_id is null then 'added' when b.version_id is null then 'removed' else 'changed' end as change
from (select version_id, max(content_sha256) as h from {_REV} where revision_no = 1 group by 1) a full join (select version_id, max(content_sha256) as h from {_REV} where revision_no = 2 group by 1) b on a.version_id = b.version_id
where a.version_id is null or b.version_id is null or a.h is distinct from b.h""",
    "dependency_change_kinds": f"""
select version_id, revision_no, case when k = 1 then '' else array_to_string(list_filter([case when content_sha256 is distinct from c then 'content_sha256' end, case when effective_from_candidate is distinct from f then 'effective_from_candidate' end, case when effective_to_candidate is distinct from t then 'effective_to_candidate' end, case when publication_date is distinct from p then 'publication_date' end], lambda x: x is not null), ',') end as changed
from (select *, row_number() over w as k, lag(content_sha256) over w as c, lag(publication_date) over w as p, lag(effective_from_candidate) over w as f, lag(effective_to_candidate) over w as t from {_REV} window w as (partition by version_id order by revision_no, recorded_at))""",
    "revision_chain_check": """
with l as (select raw_id, snapshot_no, max(delivered_at) as t from raw_files where raw_id is not null and snapshot_no is not null group by all)
select raw_id, snapshot_no, code from (
  select *, case when b is null and snapshot_no <> 1 then 'PREDECESSOR_MISSING' when snapshot_no <> b + 1 then 'PREDECESSOR_MISSING' when t < r then 'TIME_DECREASES' end as code
  from (select *, lag(snapshot_no) over w as b, lag(t) over w as r from l window w as (partition by raw_id order by snapshot_no))) where code is not null""",
    "historical_version_select": f"""
with last as (select document_id, version_id, effective_from_candidate as a, effective_to_candidate as b from {_REV} qualify row_number() over (partition by version_id order by revision_no desc, recorded_at desc) = 1),
v as (select * from (select document_id, version_id, {_date('a')} as f, case when b is null then date '9999-12-31' else {_date('b')} end as t from last) where f <= t),
s as (select distinct selection_id, document_id, {_date('event_date')} as d from historical_selection),
n as (select s.selection_id, count(v.version_id) as candidates from s left join v on v.document_id = s.document_id and s.d between v.f and v.t group by all)
select selection_id, candidates, case candidates when 0 then 'NO_CANDIDATE' when 1 then 'UNIQUE_CANDIDATE' else 'MULTIPLE_CANDIDATES' end as status from n""",
    "version_graph_cycle": f"""
with recursive {_EDGES}, reach as (select distinct g, s, t from e union select r.g, r.s, e.t from reach r join e on e.g = r.g and e.s = r.t)
select g as graph, count(*) as edges, bool_or(c) as circular from (select distinct e.g, e.s, e.t, exists (select 1 from reach r where r.g = e.g and r.s = e.s and r.t = e.s) as c from e) group by all""",
    "edge_checks": f"""
with {_EDGES}, nodes as (select distinct package_id as g, {_id('rule_id')} as n from legal_rules), c as (select g, s, t, count(*) as k from e group by all)
select g as graph, s as source, t as target, unnest(list_filter([case when not exists (select 1 from nodes where nodes.g = c.g and n = c.s) or not exists (select 1 from nodes where nodes.g = c.g and n = c.t) then 'LEGAL_RELATIONSHIP_VERSION_UNKNOWN' end, case when s = t then 'LEGAL_RELATIONSHIP_SELF_REFERENCE' end, case when k > 1 then 'LEGAL_RELATIONSHIP_DUPLICATE_EDGE' end], lambda x: x is not null)) as code from c""",
    "relation_conflict": f"""
with r as (select distinct rule_id, idx, {_id('rule_id')} as own, {_id('superseded_by')} as up, list_transform(coalesce(supersedes, []), lambda x: {_id('x')}) as below from legal_rules)
select distinct rule_id, idx, both_ways, itself from (select *, coalesce(list_contains(below, up), false) as both_ways, coalesce(list_contains(below, own), false) or coalesce(up = own, false) as itself from r) where both_ways or itself""",
    "freshness_status": """
with r as (select raw_id, snapshot_no, lower(content_sha256) as h, delivered_at as at from raw_files where raw_id is not null qualify row_number() over (partition by raw_id, snapshot_no order by delivered_at desc, lower(content_sha256) desc) = 1),
l as (select *, lag(h) over w as base, lag("at") over w as since from r window w as (partition by raw_id order by snapshot_no))
select raw_id, snapshot_no, case when h is null then 'UNAVAILABLE_DRAFT_ONLY' when h is distinct from base then 'CHANGE_DETECTED_REVIEW_REQUIRED' when (epoch_us("at") - epoch_us(since)) / 3600000000 > 24 * 30.5 then 'STALE_DRAFT_ONLY' else 'UNCHANGED_RESPONSE_BODY_CANDIDATE' end as status from l where since is not null""",
    "monitor_fold": f"with recursive {_RUNS} select * from states",
    "monitor_alerts": f"with recursive {_RUNS} select run_at, code, severity, count(*) as alerts from raised group by all",
    "monitor_overall": f"with recursive {_RUNS} select s.run_at, coalesce(n, 0) as alerts, case when critical then 'CRITICAL_DRAFT_ONLY' when n > 0 then 'WARNING_DRAFT_ONLY' else 'HEALTHY_TECHNICALLY_UNCHANGED' end as overall from (select distinct run_at from states) s left join (select run_at, count(*) as n, bool_or(code in ('LEGAL_SOURCE_CHANGE_DETECTED','LEGAL_SOURCE_ERROR_BUDGET_EXHAUSTED')) as critical from raised group by all) r using (run_at)",
    "error_budget_rolling": "select key, run_at, failures, failures > 3 as exhausted from (select user_id as key, event_id as run_at, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between 9 preceding and current row)::bigint as failures from events)",
    "rate_limit_reservations": """
with recursive r as (select user_id as key, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by event_id) as k from events),
f as (
  select key, event_id, k, t as last, 'ACCEPTED' as decision from r where k = 1
  union all
  select r.key, r.event_id, r.k, case when r.t - f.last >= 21600000000 then r.t else f.last end, case when r.t < f.last then 'CLOCK_ROLLBACK' when r.t - f.last < 21600000000 then 'INTERVAL_NOT_ELAPSED' else 'ACCEPTED' end
  from f join r on r.key = f.key and r.k = f.k + 1)
select key, event_id as request_id, decision from f""",
    "status_rollup": "select package_id, case when bool_or(status = 'DISPUTED') then 'DISPUTED' when bool_or(status = 'USER_ASSERTED') then 'USER_ASSERTED' else 'EVIDENCE_LINKED' end as status from facts where package_id is not null group by all",
    "set_coverage": """
with p as (select distinct parse_id from anchors where parse_id is not null), k as (select unnest(['CSV_CELL','DOCX_PARAGRAPH','EMAIL_HEADER','EMAIL_TEXT_LINE','TEXT_LINE','XLSX_CELL']) as kind),
m as (select p.parse_id, string_agg(k.kind, ',' order by k.kind) filter (where not exists (select 1 from anchors a where a.parse_id = p.parse_id and a.kind = k.kind)) as missing from p, k group by 1)
select parse_id, coalesce(missing, '') as missing, missing is null as complete from m""",
    "anchor_replay": """
with b as (select distinct parse_id, fact_candidate_id, pos, anchor_id from (select parse_id, fact_candidate_id, unnest(anchor_ids) as anchor_id, generate_subscripts(anchor_ids, 1) - 1 as pos from fact_candidate)),
a as (select parse_id, anchor_id, max({'kind': kind, 'coordinate': coordinate}) as a from anchors group by all)
select fact_candidate_id, pos::int as pos, b.anchor_id, coalesce(a.kind, 'MISSING') as kind, coalesce(a.coordinate, '') as coordinate from b left join a on a.parse_id = b.parse_id and a.anchor_id = b.anchor_id""",
    "anchor_hashes": "select kind, count(*) as anchors, sum((lower(text_sha256) = sha256(coalesce(text, '')))::int)::bigint as matching, sum((text_sha256 is null)::int)::bigint as without_hash from anchors group by all",
    "host_allowlist": "select distinct document_id, source_url, 'PUBLISHER_NOT_REGISTERED' as code from legal_version where not coalesce(regexp_full_match(lower(source_url), 'https://rules-[0-9]*[02468]\\.example(:443)?([/?][^#]*)?'), false)",
    "candidate_binding": f"""
with b as (select distinct selection_id, c.version_id as version_id, c.effective_from_candidate as f, c.effective_to_candidate as t from (select selection_id, unnest(candidates) as c from historical_selection)),
v as (select version_id, effective_from_candidate as f, effective_to_candidate as t from {_REV} qualify row_number() over (partition by version_id order by revision_no, recorded_at) = 1)
select selection_id, b.version_id, case when v.version_id is null then 'TARGET_MISSING' else 'BINDING_MISMATCH' end as code from b left join v on v.version_id = b.version_id where v.version_id is null or b.f is distinct from v.f or b.t is distinct from v.t""",
    "sorted_references": "select status, count(*) as facts, sum((a = list_sort(a))::int)::bigint as ascending, sum((a = list_sort(list_distinct(a)))::int)::bigint as ascending_once from (select status, list_filter(evidence_ids, lambda x: x is not null) as a from facts where evidence_ids is not null) group by all",
    "schema_violations": """
select path, keyword, count(*) as records from (
  select '$' as path, 'required' as keyword from events where event_id % 9 = 0 union all select '$.q', 'additionalProperties' from events where event_id % 9 = 0
  union all select '$.k', case when k < 10 then 'minimum' else 'maximum' end from (select event_id, cast(regexp_extract(props, '[0-9]+') as int) as k from events) where event_id % 9 <> 0 and (k < 10 or k > 79)) group by all""",
    "bound_text_anchors": f"""
with l as (select doc_id, sha256(text) as h, unnest(x) as l, generate_subscripts(x, 1) as i from (select doc_id, text, case when s[-1] = '' then s[:-2] else s end as x from (select doc_id, text, {_LINES} as s from documents)))
select doc_id, i::int as idx, 'ANCHOR-' || upper(substr(sha256('{{"content_sha256":"' || h || '","coordinate":"line:' || i || '","kind":"TEXT_LINE","raw_id":"' || doc_id || '","text_sha256":"' || sha256(l) || '","workspace_id":"WORKSPACE-1"}}'), 1, 24)) as anchor_id from l""",
    "host_multi_owner": "select lower(regexp_extract(source_url, '^https://([^/?#@:\\s]+)', 1)) as host, count(distinct document_id) as owners from legal_version where regexp_matches(source_url, '^https://[^/?#@:\\s]+(:443)?([/?][^#]*)?$') group by all having count(distinct document_id) > 1",
    "text_line_anchors": f"select doc_id, 'line:' || i as coordinate, sha256(l) as text_sha256 from (select doc_id, unnest(x) as l, generate_subscripts(x, 1) as i from (select doc_id, case when s[-1] = '' then s[:-2] else s end as x from (select doc_id, {_LINES} as s from documents)))",
    "parsed_documents": f"select doc_id, case when doc_id % 50 = 7 then 'UNKNOWN' else 'UTF8_TEXT' end as detected_format, case when doc_id % 50 = 7 then 'PARSER_FORMAT_UNSUPPORTED' else '' end as refusal_code, case when doc_id % 50 = 7 then 0 else len(x) end as anchors, case when doc_id % 50 = 7 then 0 else coalesce(list_sum([length(l) for l in x]), 0) end::bigint as characters from (select doc_id, case when s[-1] = '' then s[:-2] else s end as x from (select doc_id, {_LINES} as s from documents))",
    "csv_cell_anchors": "select n_nationkey, 'R1C' || c as coordinate, case c when 1 then n_nationkey::varchar when 2 then n_name || ', \"' else n_regionkey::varchar end as text, null::varchar as refusal_code from nation, unnest([1, 2, 3]) as u(c)",
    "jcs_snapshot": """select distinct version_id, revision_no, sha256('{"content_sha256":' || coalesce('"' || content_sha256 || '"', 'null') || ',"document_id":' || coalesce('"' || document_id || '"', 'null') || ',"revision_no":' || coalesce(revision_no::varchar, 'null') || ',"version_id":' || coalesce('"' || version_id || '"', 'null') || '}') as snapshot_sha256 from legal_version""",
    "jcs_events": "select event_id, replace(coalesce(props, ''), ' ', '') as canonical from events",
    "strict_json_input": "select event_id, ['', 'DUPLICATE_KEY', 'INVALID_CONSTANT', 'ROOT_NOT_OBJECT', 'INVALID_JSON', 'TOO_DEEPLY_NESTED', 'TOO_LARGE'][event_id % 7 + 1] as code from events",
    "integrity_report": f"""
with {_IDS}, {_SUMS}, al as (
  select record_id, code, severity = 'P0' as p0 from idf
  union all select record_id, code, code in ('FACT_EVIDENCE_MISSING', 'CALCULATION_RESULT_MISMATCH') from (
    {_f('facts', _none('evidence_ids') + " and status = 'EVIDENCE_LINKED'", 'FACT_EVIDENCE_MISSING')}
    union all {_f('statements', _none('fact_ids'), 'STATEMENT_FACTS_MISSING')}
    union all {_f('statements', _none('rule_ids'), 'STATEMENT_RULES_MISSING')}
    union all {_f('statements', "coalesce(trim(text), '') = ''", 'STATEMENT_TEXT_MISSING')}
    union all {_f('evidence', 'location is null', 'EVIDENCE_LOCATION_MISSING')}
    union all {_f('calculations', 'not ' + _DEC.format('result'), 'CALCULATION_RESULT_INVALID')}
    union all {_f("(select c.package_id from calculations c join again a on a.calculation_id = c.calculation_id and a.idx is not distinct from c.idx and a.declared = c.result where c.formula_id = 'SUM_DECIMAL_INPUTS' and a.recomputed <> c.result)", 'true', 'CALCULATION_RESULT_MISMATCH')}
    union all {_f('legal_rules', f"({_date('effective_from')}) is null or (effective_to is not null and ({_date('effective_to')}) is null)", 'DATE_FORMAT_INVALID')}
    union all {_f('legal_rules', f"({_date('effective_to')}) < ({_date('effective_from')})", 'DATE_INTERVAL_INVALID')})),
c as (select record_id, code, count(*) as n, count(*) filter (where p0) as p0 from al where record_id is not null group by all),
r as (select record_id, sum(n)::bigint as findings, sum(p0)::bigint as p0, string_agg(code || ':' || n, ',' order by code || ':' || n) as codes from c group by all)
select k.record_id, r.findings is null as allowed, coalesce(r.findings, 0) as findings, coalesce(r.p0, 0) as p0_findings, coalesce(r.codes, '') as codes
from (select package_id as record_id from facts union select package_id from evidence) k left join r using (record_id) where k.record_id is not null""",
}
SQL["stream_reservations"] = SQL["rate_limit_reservations"]
