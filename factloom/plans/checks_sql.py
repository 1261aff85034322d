"""The same results as plans.checks in SQL."""

from factloom.plans.domain_sql import _date, _id
from factloom.plans.records_sql import _EDGES, _IDS, _RUNS

_TYPED = f"""
{_EDGES}, place as (select package_id as g, {_id('rule_id')} as n, min(jurisdiction.province) as province from legal_rules group by all),
typed as (select e.g, e.s, e.t, case when a.province is not distinct from b.province then 'SUPERSEDES' else 'CONFLICTS_WITH' end as kind
  from e left join place a on a.g = e.g and a.n = e.s left join place b on b.g = e.g and b.n = e.t)"""
_PROMISED = "case lower(extension) when '.gif' then 'image/gif' when '.gz' then 'application/gzip' when '.jpeg' then 'image/jpeg' when '.jpg' then 'image/jpeg' when '.pdf' then 'application/pdf' when '.png' then 'image/png' when '.txt' then 'text/plain' when '.zip' then 'application/zip' end"
_RULES = """
rules as (select *, case when key % 7 = 0 then 48 else 24 * (1 + key % 3) end as iv, case when key % 7 = 0 then 24 else 12 * (1 + key % 2) end as rt, case when key % 7 = 0 then 7 else 3 + key % 5 end as wd, case when key % 7 = 0 then 3 else 1 + key % 3 end as bg from runs),
stx as (
  select key, run_at, k, iv, rt, wd, bg, case when technical is null then 'MISSED_DUE_CHECK' else 'CHECKED' end as execution, coalesce(technical, 'NOT_CHECKED_MISSED_DRAFT_ONLY') as technical,
    run_at + case when technical is null or technical = 'UNAVAILABLE_DRAFT_ONLY' then rt else iv end as next_due, [case when technical is null or technical = 'UNAVAILABLE_DRAFT_ONLY' then 1 else 0 end] as recent
  from rules where k = 1
  union all
  select r.key, r.run_at, r.k, r.iv, r.rt, r.wd, r.bg,
    case when r.technical is not null then 'CHECKED' when r.run_at >= s.next_due then 'MISSED_DUE_CHECK' else 'CARRIED_FORWARD_NOT_DUE' end,
    case when r.technical is not null then r.technical when r.run_at >= s.next_due then 'NOT_CHECKED_MISSED_DRAFT_ONLY' else s.technical end,
    case when r.technical is null and r.run_at < s.next_due then s.next_due else r.run_at + case when r.technical is null or r.technical = 'UNAVAILABLE_DRAFT_ONLY' then r.rt else r.iv end end,
    case when r.technical is null and r.run_at < s.next_due then s.recent else list_slice(list_append(s.recent, case when r.technical is null or r.technical = 'UNAVAILABLE_DRAFT_ONLY' then 1 else 0 end), -r.wd, -1) end
  from stx s join rules r on r.key = s.key and r.k = s.k + 1),
bysource as (select key, run_at, execution, technical, next_due::bigint as next_due, list_sum(recent)::int as failures, list_sum(recent) > bg as exhausted from stx)"""
_HOST = r"lower(regexp_extract(source_url, '^https://([^/?#@:\s]+)(:443)?([/?][^#]*)?$', 1))"
_HEAD = "select {0}::bigint as {1}, '{2}' as detected_format, {3} as kind, {4} as coordinate, {5} as text, '{6}' as warnings from {7}"


def _number(x: str) -> str:
    """A double as text without an exponent or a needless fraction; for values between 1e-6 and 1e21."""
    return f"regexp_replace(case when ({x})::double >= 1e15 then ({x})::double::decimal(38,0)::varchar else ({x})::double::varchar end, '\\.0$', '')"


SQL = {
    "typed_graph_cycle": f"""
with recursive {_TYPED}, a as (select distinct g, s, t from typed where kind = 'SUPERSEDES'), reach as (select g, s, t from a union select r.g, r.s, a.t from reach r join a on a.g = r.g and a.s = r.t),
found as (select g, count(*) as n, bool_or(exists (select 1 from reach r where r.g = a.g and r.s = a.s and r.t = a.s)) as c from a group by g)
select distinct e.g as graph, coalesce(n, 0) as edges, coalesce(c, false) as circular from edges e left join found on found.g = e.g where e.g in (select g from e)""",
    "typed_edge_checks": f"""
with {_TYPED}, nodes as (select distinct package_id as g, {_id('rule_id')} as n from legal_rules), c as (select g, s, t, kind, count(*) as k from typed group by all),
f as (select *, unnest(list_filter([case when not exists (select 1 from nodes where nodes.g = c.g and n = c.s) or not exists (select 1 from nodes where nodes.g = c.g and n = c.t) then 'LEGAL_RELATIONSHIP_VERSION_UNKNOWN' end, case when s = t then 'LEGAL_RELATIONSHIP_SELF_REFERENCE' end, case when k > 1 then 'LEGAL_RELATIONSHIP_DUPLICATE_EDGE' end], lambda x: x is not null)) as code from c)
select g as graph, s as source, t as target, kind, code, case code when 'LEGAL_RELATIONSHIP_DUPLICATE_EDGE' then k - 1 else k end as rows from f""",
    "media_mismatch": f"select extension, detected_media_type, extension_media_type_mismatch, coalesce({_PROMISED} <> detected_media_type, false) as again, count(*) as files from raw_files group by all",
    "file_relationships": """
with m as (select sha256(text) as c, sha256(concat_ws(':', source, n_chars::varchar)) as f, 'RAW-' || sha256(unhex(hex(encode(source || '/' || doc_id || '.txt')) || '00' || sha256(text))) as raw_id from documents)
select 'DUPLICATE_CONTENT' as relationship_type, c as identity_sha256, raw_id from m where c is not null qualify count(*) over (partition by c) > 1
union all select 'HARDLINK_CANDIDATE', f, raw_id from m where f is not null qualify count(*) over (partition by f) > 1""",
    "file_times": """
select 'x/' || doc_id || case when n_chars > 500 then '.GIF' else '.md' end as relative_path, case when n_chars > 500 then '.gif' else '.md' end as extension, n_chars > 500 as extension_media_type_mismatch, (epoch_us(created_at) * 1000)::varchar as modified_at_ns from documents""",
    "monitor_by_source": f"with recursive {_RUNS}, {_RULES} select * from bysource",
    "monitor_alert_ids": f"""
with recursive {_RUNS}, {_RULES},
up as (
  select key, run_at, 'LEGAL_SOURCE_' || case technical when 'CHANGE_DETECTED_REVIEW_REQUIRED' then 'CHANGE_DETECTED' when 'UNAVAILABLE_DRAFT_ONLY' then 'CHECK_UNAVAILABLE' when 'STALE_DRAFT_ONLY' then 'CHECK_STALE' else 'CHECK_MISSED' end as code,
    case technical when 'CHANGE_DETECTED_REVIEW_REQUIRED' then 'CRITICAL' when 'STALE_DRAFT_ONLY' then 'HIGH' else case when key % 3 in (0, 1) then 'HIGH' else 'WARNING' end end as severity
  from bysource where technical <> 'UNCHANGED_RESPONSE_BODY_CANDIDATE'
  union all select key, run_at, 'LEGAL_SOURCE_ERROR_BUDGET_EXHAUSTED', case when key % 3 = 0 then 'CRITICAL' else 'HIGH' end from bysource where exhausted),
ids as (select *, 'CHK-' || key || '-' || run_at as chk, code <> 'LEGAL_SOURCE_CHECK_MISSED' as made from up)
select key, run_at, code, severity, 'LMALERT-' || upper(substr(sha256('{{"check_id":' || case when made then '"' || chk || '"' else 'null' end || ',"check_snapshot_sha256":' || case when made then '"' || sha256(chk) || '"' else 'null' end
  || ',"code":"' || code || '","evaluated_at":"' || strftime(make_timestamp(run_at * 3600000000), '%Y-%m-%dT%H:%M:%SZ') || '","source_monitor_id":"SRC-' || key || '"}}'), 1, 24)) as alert_id from ids""",
    "candidate_matrix": "select distinct fact_candidate_id, provenance_state, confirmation_status from fact_candidate where coalesce((provenance_state, confirmation_status) not in (('EXTRACTED', 'NOT_HUMAN_CONFIRMED'), ('USER_ANNOTATED', 'USER_CONFIRMED_UNAUTHENTICATED'), ('ADJUDICATED', 'DOCUMENT_PASSAGE_CLASSIFIED_UNAUTHENTICATED')), true)",
    "exact_anchor_text": """
with c as (select distinct fact_candidate_id, parse_id, assertion_text, len(anchor_ids)::int as anchors, anchor_ids[1] as anchor_id from fact_candidate where provenance_state in ('EXTRACTED', 'ADJUDICATED')),
a as (select parse_id, anchor_id, max(coalesce(text, '')) as text from anchors group by all)
select fact_candidate_id, anchors, a.text is not null as anchor_known from c left join a on a.parse_id = c.parse_id and a.anchor_id = c.anchor_id where not (anchors = 1 and c.assertion_text is not distinct from a.text)""",
    "predecessor_check": """
with v as (select distinct version_id, revision_no, content_sha256 as h from legal_version where version_id is not null and revision_no is not null),
o as (select *, row_number() over w as k, coalesce(first_value(h) over w, '') as f, lag(coalesce(h, '')) over w as before from v window w as (partition by version_id order by revision_no, h nulls first))
select version_id, revision_no, 'PREDECESSOR_MISMATCH' as code from o where before is distinct from case when k > 1 then f end""",
    "allowlist_purposes": f"""
with r as (select distinct document_id, source_url, nullif({_HOST}, '') as host from legal_version),
n as (select *, regexp_extract(host, '^rules-([0-9]+)', 1) as num, case when length(document_id) % 2 = 0 then 'CASE' else 'RULE' end as purpose from r),
k as (select distinct num, host, try_cast(num as int) % 3 = 0 as permits from n where host is not null and try_cast(num as int) % 5 <> 1)
select distinct document_id, source_url, code from (
  select document_id, source_url, case when n.num is null or not exists (select 1 from k where k.num = n.num) then 'PUBLISHER_NOT_REGISTERED' when not exists (select 1 from k where k.num = n.num and k.permits) then 'PURPOSE_NOT_PERMITTED'
    when not exists (select 1 from k where k.num = n.num and k.host = n.host) then 'TARGET_NOT_ALLOWLISTED' end as code from n) where code is not null""",
    "conflict_limit": """
select 'FACT_ANALYSIS_CONFLICT_LIMIT_EXCEEDED' as code, n as conflicts from (
  select coalesce(sum((a * a - b) // 2), 0)::bigint as n from (select user_id, sum(c)::bigint as a, sum(c * c)::bigint as b from (select user_id, event_type, count(*) as c from events where user_id is not null group by all) group by 1)) where n > 10000""",
    "report_exit_codes": f"with {_IDS} select package_id as record_id, (package_id in (select record_id from idf where record_id is not null))::int as exit_code from (select distinct package_id from facts where package_id is not null)",
    "text_diff_append": r"""
with l as (select doc_id, strlen(text) + 17 > 1048576 as large, len(string_split_regex(text || chr(10), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) - 1 as n from documents)
select doc_id, case when large then 'REFUSED' else 'INSERT' end as tag, case when large then 0 else n end::int as from_start_line, case when large then 0 else n end::int as from_end_line, case when large then 0 else n end::int as to_start_line,
  case when large then 0 else n + 1 end::int as to_end_line, '' as removed_text, case when large then '' else 'END OF THE TEXT' || chr(10) end as added_text from l""",
    "superseded_differences": f"""
with r as (select package_id as graph, {_id('rule_id')} as rule, supersedes, {_id('superseded_by')} as by_ from legal_rules),
a as (select distinct graph, rule as older, by_ as newer from r where graph is not null and rule is not null and by_ is not null),
b as (select distinct * from (select graph, {_id('x')} as older, rule as newer from (select graph, rule, unnest(supersedes) as x from r)) where graph is not null and older is not null and newer is not null)
select *, 'ONLY_DECLARED' as code, 1::bigint as rows from (select * from a except select * from b) union all select *, 'ONLY_DERIVED', 1 from (select * from b except select * from a)""",
    "selection_checks": f"""
with s as (select selection_id, {_date('event_date')} as d, selection_status, candidates, list_transform(candidates, lambda c: c.version_id) as ids from historical_selection where candidates is not null),
v as (select *, list_bool_and(list_transform(candidates, lambda c: coalesce(regexp_full_match(c.effective_from_candidate, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(c.effective_from_candidate as date) <= d
  and case when c.effective_to_candidate is null then true else regexp_full_match(c.effective_to_candidate, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and d <= try_cast(c.effective_to_candidate as date) and try_cast(c.effective_from_candidate as date) <= try_cast(c.effective_to_candidate as date) end, false))) as ok from s)
select code, count(*) as selections from (select case when ids is distinct from list_sort(list_distinct(ids)) then 'CANDIDATES_NOT_SORTED'
  when selection_status is distinct from case len(candidates) when 0 then 'NO_CANDIDATE' when 1 then 'UNIQUE_CANDIDATE' else 'MULTIPLE_CANDIDATES' end then 'STATUS_MISMATCH' when not coalesce(ok, true) then 'EVENT_NOT_COVERED' else 'VALID' end as code from v) where code is not null group by all""",
    "raw_file_checks": f"""
select distinct snapshot_no, package_id, raw_id, idx, code from (select *, case when not coalesce(relative_path <> '' and not contains(relative_path, chr(92)) and relative_path not like '/%' and not list_contains(string_split(relative_path, '/'), '..') and not regexp_full_match(relative_path, '[./]*'), false) then 'PATH_UNSAFE'
  when not coalesce(regexp_full_match(raw_id, 'RAW-[0-9a-f]{{64}}'), false) then 'RAW_ID_INVALID' when not coalesce(regexp_full_match(lower(content_sha256), '[0-9a-f]{{64}}'), false) then 'HASH_INVALID'
  when extension is distinct from lower(regexp_extract(relative_path, '[^/](\\.[^./]+)$', 1)) then 'EXTENSION_MISMATCH' when extension_media_type_mismatch <> coalesce({_PROMISED} <> detected_media_type, false) then 'MEDIA_FLAG_MISMATCH' end as code from raw_files) where code is not null""",
    "object_paths": "select lower(content_sha256) as content_sha256, count(*) as files, 'objects/' || substr(lower(content_sha256), 1, 2) || '/' || lower(content_sha256) || '.bin' as object_path from raw_files where regexp_full_match(lower(content_sha256), '[0-9a-f]{64}') group by 1, 3",
    "fact_findings": f"""
select record_id, code, path, count(*) as rows from (
  select package_id as record_id, 'facts[' || idx || ']' as path, unnest(list_filter([case when status is null or status not in ('USER_ASSERTED', 'DISPUTED') then 'FACT_STATUS_NOT_ALLOWED' end,
    case when status = 'EVIDENCE_LINKED' and coalesce(len(list_filter(evidence_ids, lambda x: {_id('x')} is not null)), 0) = 0 then 'FACT_EVIDENCE_MISSING' end, case when coalesce(trim(summary), '') = '' then 'FACT_SUMMARY_MISSING' end], lambda x: x is not null)) as code from facts) group by all""",
    "freshness_checks": """
with r as (select raw_id, snapshot_no, lower(content_sha256) as h, delivered_at as t from raw_files where raw_id is not null qualify row_number() over (partition by raw_id, snapshot_no order by delivered_at desc, lower(content_sha256) desc) = 1),
l as (select *, lag(t) over (partition by raw_id order by snapshot_no) as base from r)
select raw_id, snapshot_no, case when h is null then 'OBSERVATION_MISSING' else 'OBSERVATION_NOT_LATER' end as code from l where base is not null and (h is null or t <= base)""",
    "check_errors": """
with e as (select strftime(ts, '%Y-%m-%d') as day, user_id, count(*) as n from events where event_type = 'error' group by all), k as (select distinct c_custkey from customer where c_acctbal > 0)
select day, user_id, case when c_custkey is null then 'LEGAL_MONITOR_CHECK_SOURCE_UNKNOWN' else 'LEGAL_MONITOR_CHECK_DUPLICATE' end as code from e left join k on c_custkey = user_id where c_custkey is null or n > 1""",
    "unresolved_packages": "select package_id, bool_or(coalesce(status not in ('EVIDENCE_LINKED', 'USER_ASSERTED'), true)) as unresolved from facts where package_id is not null group by all",
    "evidence_coverage": f"""
with n as (select distinct package_id, {_id('x')} as id from (select package_id, unnest(evidence_ids) as x from facts)), k as (select distinct package_id, {_id('evidence_id')} as id from evidence),
j as (select coalesce(n.package_id, k.package_id) as package_id, n.id as l, k.id as r from (select * from n where id is not null and package_id is not null) n full join (select * from k where id is not null and package_id is not null) k on n.package_id = k.package_id and n.id = k.id)
select package_id, count(*) filter (where l is not null and r is not null) as common, count(*) filter (where r is null) as only_left, count(*) filter (where l is null) as only_right, bool_and(l is not null and r is not null) as same from j group by all""",
    "unused_evidence": f"""
with n as (select distinct package_id, {_id('x')} as id from (select package_id, unnest(evidence_ids) as x from facts)), k as (select distinct package_id, {_id('evidence_id')} as id from evidence)
select * from k where package_id is not null and id is not null and not exists (select 1 from n where n.package_id = k.package_id and n.id = k.id)""",
    "anchor_chain": """
with c as (select distinct fact_candidate_id, parse_id, anchor_ids[1] as anchor_id, sha256(coalesce(assertion_text, '')) as h from fact_candidate), a as (select parse_id, anchor_id, max(lower(text_sha256)) as h from anchors group by all)
select fact_candidate_id, code from (select c.fact_candidate_id, case when a.anchor_id is null then 'ANCHOR_MISSING' when a.h is null then 'ANCHOR_WITHOUT_HASH' when a.h <> c.h then 'ASSERTION_MISMATCH' end as code from c left join a on a.parse_id = c.parse_id and a.anchor_id = c.anchor_id) where code is not null""",
    "document_headers": "select doc_id, code from (select doc_id, case when lang is null then 'LANGUAGE_MISSING' when n_chars is distinct from length(text) then 'LENGTH_MISMATCH' when package_id is null then 'PACKAGE_MISSING' when text = '' then 'TEXT_EMPTY' end as code from documents) where code is not null",
    "parse_counts": "select parse_id, count(*) as anchors, sum(coalesce(length(text), 0))::bigint as characters, count(distinct kind) as kinds from (select distinct parse_id, anchor_id, kind, text from anchors where parse_id is not null) group by all",
    "docx_anchors": " union all ".join(_HEAD.format("s_suppkey", "supplier", "DOCX", "'DOCX_PARAGRAPH'", f"'word/document.xml#paragraph:{k}'", t, "", "supplier") for k, t in ((1, "s_name || ' <&> ' || s_nationkey"), (2, "''"), (3, "'余额 ' || s_suppkey"))),
    "xlsx_anchors": " union all ".join(_HEAD.format("c_custkey", "customer", "XLSX", "'XLSX_CELL'", f"'sheet:S!{c}1'", t, "SPREADSHEET_FORMULA_PRESENT_NOT_EVALUATED", "customer") for c, t in (("A", "c_name"), ("B", "c_mktsegment"), ("Z", "'=A1'"))),
    "eml_anchors": " union all ".join(
        _HEAD.format("s_suppkey", "supplier", "EML", f"'{k}'", f"'{c}'", t, "", "supplier")
        for k, c, t in (("EMAIL_HEADER", "header:subject", "s_name"), ("EMAIL_HEADER", "header:from", "'a@example.test'"), ("EMAIL_TEXT_LINE", "part:1:line:1", "'Nation ' || s_nationkey"), ("EMAIL_TEXT_LINE", "part:1:line:2", "'End'"))
    ),
    "zip_anchors": " union all ".join(_HEAD.format("c_custkey", "customer", "ZIP", "'ARCHIVE_ENTRY'", f"'entry:{k}'", f"list_sort([c_mktsegment || '/x.txt', c_name || '.md'])[{k}]", "ARCHIVE_CONTENT_NOT_RECURSIVELY_PARSED", "customer") for k in (1, 2)),
    "csv_anchors": " union all ".join(
        _HEAD.format("c_custkey", "customer", "CSV", "'CSV_CELL'", f"'R{r}C{c}'", t, "", "customer") for r in (1, 2) for c, t in ((1, "c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'x'"), (2, "''"), (3, "c_nationkey::varchar"))
    ),
    "jcs_orders": f"""
with n as (select o_orderkey, o_orderstatus, {_number('o_totalprice')} as total, {_number('o_totalprice / 1000')} as small, {_number('o_totalprice * 1e6')} as large from orders),
c as (select o_orderkey, '{{"Key":' || o_orderkey || ',"even":' || (o_orderkey % 2 = 0)::varchar || ',"inner":{{"none":null,"s\\t\\"q":"' || o_orderstatus || '","é":[' || small || ',' || large || ']}},"total":' || total || '}}' as canonical from n)
select o_orderkey, canonical, sha256(canonical) as snapshot from c""",
}
