"""SQL oracle (DuckDB dialect) for the registered queries.

Each text reads the pre-registered base tables, spells the same adapter as
``pulsegrid.sources.fixtures`` in SQL and states the query independently
of the Spark code. Column names equal the Spark output's.
"""

from __future__ import annotations

from pulsegrid.plans import catalog as C

# Fixed value: IPv4 pattern for full-match (same language as the Spark check).
_OCT = "25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]"
IPV4_RE = f"(?i:::ffff:)?(?:{_OCT})(?:\\.(?:{_OCT})){{3}}"
# One address, alone or in <> after a name of plain words.
_DOTTED = "[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)*"
EMAIL_RE = f"({_DOTTED}@{_DOTTED}|([A-Za-z]+ )*<{_DOTTED}@{_DOTTED}>)"

A = {
    "hb": """select event_id as seq, cast(user_id as varchar) as server_id,
        case when event_type = 'error' then 'off' else 'on' end as status, ts from events""",
    "hb_nulls": """select event_id as seq, cast(user_id as varchar) as server_id,
        case when user_id = 7 or event_id % 11 = 0 then null
             when event_type = 'error' then 'off' else 'on' end as status, ts from events""",
    "hb_wide": """select l_orderkey * 10 + l_linenumber as seq, cast(l_orderkey as varchar) as server_id,
        case when l_returnflag = 'R' then 'off' else 'on' end as status, l_shipdate as ts
        from lineitem""",
    "servers": """select cast(c_custkey as varchar) as server_id, c_name as server_name,
        concat('10.', cast(cast(floor(c_custkey / 65536) as bigint) % 256 as varchar), '.',
               cast(cast(floor(c_custkey / 256) as bigint) % 256 as varchar), '.',
               cast(c_custkey % 256 as varchar)) as ipv4,
        'UNKNOWN' as status,
        timestamp '2024-01-01 00:00:00' + c_custkey * interval '1' minute as created_at,
        cast(null as timestamp) as metadata_updated_at,
        case when c_custkey % 6 = 0 then timestamp '2030-01-01 00:00:00'
             when c_custkey % 3 = 0 then timestamp '2020-01-01 00:00:00' end as last_ping_at,
        c_custkey % 10 = 9 as is_deleted from customer""",
    "imp_simple": """select p_partkey as rn, concat('s', cast(p_partkey // 4 as varchar)) as server_id,
        p_name as server_name,
        case when p_partkey % 7 = 3 then '300.1.1.1'
             when p_partkey % 13 = 5 then '01.2.3.4' else '10.0.0.1' end as ipv4 from part""",
    "imp_chain": """select o_orderkey as rn, concat('s', cast(o_custkey as varchar)) as server_id,
        concat('n', cast(o_orderkey // 12 as varchar)) as server_name from orders""",
    "imp_files": """select cast(p_partkey // 100 as varchar) as file_id, p_partkey as rn,
        case when p_partkey % 997 = 5 then 2 else 4 end as ncell from part""",
    "changelog": """select o_orderkey as seq, cast(o_custkey as varchar) as server_id,
        case when o_orderstatus = 'F' then 'delete' else 'put' end as op from orders""",
    "patches": """select c_custkey as rn, cast((c_custkey // 3) * 5 as varchar) as server_id,
        case when c_custkey % 10 = 5 then c_name when c_custkey % 2 = 0 then ''
             else concat('new-', cast(c_custkey // 4 as varchar)) end as server_name,
        case when c_custkey % 11 = 4 then '300.1.1.1' when c_custkey % 3 = 0 then null
             else concat('10.9.9.', cast(c_custkey % 256 as varchar)) end as ipv4 from customer""",
    "creates": """select cast((c_custkey // 2) * 15 as varchar) as server_id,
        case when c_custkey % 4 = 0 then c_name else concat('srv-', cast(c_custkey // 3 as varchar)) end as server_name,
        case when c_custkey % 9 = 2 then '1.2.3' else '10.1.1.1' end as ipv4, c_custkey as rn from customer""",
    "registry_small": """select concat('s', cast(s_suppkey * 2 as varchar)) as server_id,
        concat('n', cast(s_suppkey * 3 as varchar)) as server_name from supplier""",
    "mail_items": """select conv_id as mail_id, turn as pos,
        concat('report-', cast(conv_id as varchar), '-', cast(turn as varchar), '.csv') as filename
        from conversations""",
    "mail_files": """select distinct concat('report-', cast(conv_id as varchar), '-', cast(turn as varchar), '.csv')
        as filename from conversations where (conv_id + turn) % 5 <> 0""",
    "raw_messages": """select event_id as seq, case event_id % 50
        when 0 then 'not json'
        when 1 then concat('{"server_id":"', user_id, '","status":"on","timestamp":"yesterday"}')
        when 2 then concat('{"server_id":"', user_id, '"}')
        when 3 then concat('{"server_id":"', user_id, '","status":"on","extra":1,"timestamp":"2024-01-01T00:00:00Z"}')
        when 4 then concat('{"server_id":"', user_id, '","status":"on","timestamp":"2024-01-01T00:00:00Z"}]')
        when 5 then '{"server_id":{"a":1},"status":"on","timestamp":"2024-01-01T00:00:00Z"}'
        when 6 then concat('{"server_id":"', user_id, '","status":1,"timestamp":"2024-01-01T00:00:00Z"}')
        when 7 then concat('{"server_id":"', user_id, '","status":"on","timestamp":"1969-12-31T23:59:58.25Z"}')
        when 8 then '{"server_id":null,"status":"on","timestamp":"2024-01-01T00:00:00Z"}'
        when 9 then concat(good, ',"x":1') when 10 then concat(good, ',"m2":{"q":[1]}')
        when 11 then concat(good, ',', good) when 12 then concat(good, '} x')
        when 13 then concat('{"Server_ID":"', user_id, '","STATUS":"off","TimeStamp":"2024-01-02T03:04:05Z"}')
        when 14 then concat('{"server_id":"first","SERVER_ID":"', user_id,
                            '","status":"on","status":"off","timestamp":"2024-01-01T00:00:00Z"}')
        when 15 then concat('{"server_id":"', user_id,
                            '","server_id":null,"status":"on","timestamp":"2024-01-01T00:00:00Z"}')
        when 16 then concat('{"server_id":7,"server_id":"', user_id, '","status":"on","timestamp":"2024-01-01T00:00:00Z"}')
        when 17 then concat(' ', good, chr(10))
        when 18 then concat('{"a":{"b":1,"b":2},"timestamp":"2024-01-01T00:00:00Z","server_id":"', user_id, '"}')
        else concat('{"server_id":"', user_id, '","status":"', case when event_type = 'error' then 'off' else 'on' end,
                    '","timestamp":"2024-01-', lpad(cast(1 + event_id % 28 as varchar), 2, '0'), 'T00:00:00Z"}')
        end as value from (select *, concat('{"server_id":"', user_id,
                             '","status":"on","timestamp":"2024-01-01T00:00:00Z"}') as good from events)""",
    "probe_log": """select event_id as seq, case
        when event_id % 60 = 0 then '{"ServerID":"1","IP":5}' when event_id % 60 = 20 then concat(request, request)
        when event_id % 60 = 40 then concat(request, ',"m2":{}')
        when event_id % 20 = 7 then concat('{"ip":"10.9.9.9","serverid":"', user_id, '","Serverid":null}')
        else request end as value
        from (select *, concat('{"ServerID":"', user_id, '","ServerName":"n\\"', user_id, '","IP":"10.0.0.1"}')
              as request from events)""",
    "raw_mails": """select seq, case seq % 35 when 28 then concat(value, ',"Mail":{}') when 0 then concat(value, ' x')
          when 7 then '{"Mail":{"Attachments":"oops"}}' when 14 then '{"Mail":{"To":"x"}}'
          when 21 then '{"Mail":{"Attachments":[{"Filename":1}]}}' else value end as value
        from (select conv_id as seq, concat('{"Mail":{"From":"","To":[],"Subject":"","Body":"","Attachments":[',
                string_agg(concat('{"Filename":"report-', conv_id, '-', turn, '.csv"}'), ',' order by turn), ']}}') as value
              from conversations group by conv_id)""",
    "probe_results": """select event_id as seq, cast(user_id as varchar) as server_id,
        case when event_type = 'error' then 'timeout' else null end as error,
        event_id % 3 as packets_recv, ts as probed_at from events""",
    "page_requests": """select p_partkey as req_id, cast(p_partkey % 12 - 2 as int) as from_row,
        cast(p_partkey % 12 - 2 + p_partkey * 3 % 150 - 5 as int) as to_row,
        case p_partkey % 4 when 0 then 'created_at' when 1 then 'server_name'
             when 2 then 'status' else 'SERVER_NAME' end as sort_field from part""",
    "report_requests": """select p_partkey as req_id, timestamp '2024-01-05 00:00:00' as from_ts,
        timestamp '2024-01-04 00:00:00' + (p_partkey % 3) * interval '1' day as to_ts,
        case p_partkey % 7 when 0 then [] when 1 then ['no-at-sign']
             when 2 then [concat('ops', p_partkey, '@example.com'), concat('Ops Team <o.', p_partkey, '@x.example.org>')]
             when 3 then [concat('ops', p_partkey, '@example.com'), 'a..b@c.example']
             when 4 then [concat('Ops Team <o.', p_partkey, '@x.example.org>'),
                          concat('ops', p_partkey, '@example.com'), 'last@example.net']
             else [concat('ops', p_partkey, '@example.com')] end as receivers
        from part""",
}


def _with(*names: str) -> str:
    return "with " + ",\n".join(f"{n} as ({A[n]})" for n in names) + "\n"


def _ratio() -> str:
    return ("coalesce(count(*) filter (where status = 'on') * 1.0e0 / nullif(count(status), 0), 0.0)"
            " as uptime_ratio")


def _report(src: str, ranged: bool) -> str:
    where = (f"where ts >= timestamp '{C.REPORT_FROM}' and ts < timestamp '{C.REPORT_TO}'"
             if ranged else "")
    return f"""select server_id, min(ts) as start_ping_at, max(ts) as last_ping_at, {_ratio()},
        count(*) as doc_count from {src} {where} group by server_id
        order by doc_count desc, server_id limit 10000"""


def _fmt(col: str) -> str:
    return f"coalesce(strftime({col}, '%Y-%m-%d %H:%M:%S'), '0001-01-01 00:00:00')"


_LATEST = """latest as (select server_id, status, ts from (
        select *, row_number() over (partition by server_id order by ts desc, seq desc) as rk
        from hb) where rk = 1)"""

_UPSERT = _with("hb", "servers") + ", " + _LATEST + """
select s.server_id,
  case when l.ts is not null and (s.last_ping_at is null or l.ts >= s.last_ping_at)
       then l.status else s.status end as status,
  case when l.ts is not null and (s.last_ping_at is null or l.ts >= s.last_ping_at)
       then l.ts else s.last_ping_at end as last_ping_at,
  s.is_deleted
from servers s left join latest l on s.server_id = l.server_id"""


def _greedy(src_sql: str, registry_sql: str | None) -> str:
    """Two-key insert in order, as a recursion with one step per round: a
    row first (by rn) in both its id group and its name group is accepted;
    undecided rows sharing an id or a name with a row accepted in that
    round are rejected; the rest go to the next round. Rows whose id or
    name the registry holds are rejected up front."""
    if registry_sql is None:
        c0 = f"select rn, server_id, server_name from ({src_sql})"
    else:
        c0 = f"""select rn, server_id, server_name from ({src_sql})
        where server_id not in (select server_id from ({registry_sql}))
          and server_name not in (select server_name from ({registry_sql}))"""
    return f"""c0 as ({c0}),
    r(rn, server_id, server_name, state) as (
      select rn, server_id, server_name, 'u' from c0
      union all
      select rn, server_id, server_name,
        case when acc then 'a'
             when max(acc::int) over (partition by server_id) = 1
               or max(acc::int) over (partition by server_name) = 1 then 'x'
             else 'u' end
      from (select *, rn = min(rn) over (partition by server_id)
                      and rn = min(rn) over (partition by server_name) as acc
            from r where state = 'u') s),
    accepted as (select rn from r where state = 'a')"""


def _daily(cap: bool) -> str:
    base = f"""select cast(ts as date) as day, server_id, min(ts) as start_ping_at,
        max(ts) as last_ping_at, {_ratio()}, count(*) as doc_count from hb group by 1, 2"""
    if not cap:
        return base
    return f"""select * from ({base}) qualify row_number() over (
        partition by day order by doc_count desc, server_id) <= 10000"""


def _patched() -> str:
    """The patch requests one after the other: each step holds the whole
    registry after the step's request, and that request's outcome."""
    held = "max(s.server_id <> q.server_id and s.server_name = q.want) over ()"
    found = "max(s.server_id = q.server_id and not s.is_deleted) over ()"
    outcome = f"""case when q.new_ip is not null and not regexp_full_match(q.new_ip, '{IPV4_RE}')
          then 'invalid ipv4' when not {found} then 'record not found'
          when q.want is not null and {held} then 'duplicate server id or server name'
          else 'updated' end"""
    mine = "outcome = 'updated' and server_id = target"
    return "with recursive " + ", ".join(f"{n} as ({A[n]})" for n in ("patches", "servers")) + f""",
    q as (select rn, server_id, nullif(server_name, '') as want, nullif(ipv4, '') as new_ip,
          row_number() over (order by rn) as k from patches),
    s as (
      select cast(0 as bigint) as step, server_id, server_name, ipv4, metadata_updated_at, is_deleted,
             cast(null as varchar) as outcome from servers
      union all
      select step, server_id, case when {mine} then coalesce(want, server_name) else server_name end,
        case when {mine} then coalesce(new_ip, ipv4) else ipv4 end,
        case when {mine} then timestamp '{C.PATCH_AS_OF}' else metadata_updated_at end, is_deleted, outcome
      from (select q.k as step, s.server_id, s.server_name, s.ipv4, s.metadata_updated_at, s.is_deleted,
              q.server_id as target, q.want, q.new_ip, {outcome} as outcome
            from s join q on q.k = s.step + 1) t)"""


def _members(src: str, *names: str) -> str:
    """The text itself is judged: valid JSON, an object, members of these
    names in any case that are all text or null, the last text of each."""
    def of(n: str) -> str:
        return f"lower(e.key) = '{n.lower()}'"
    ok = " and ".join(f"coalesce(bool_and(e.type in ('VARCHAR', 'NULL')) filter ({of(n)}), true)" for n in names)
    last = ", ".join(f"coalesce(last(e.atom ->> '$' order by e.id) filter ({of(n)} and e.type = 'VARCHAR'), '')"
                     f" as {n}" for n in names)
    return f""", objects as (select seq, case when json_valid(value) and json_type(value) = 'OBJECT'
          then value else '{{}}' end as value, json_valid(value) and json_type(value) = 'OBJECT' as whole
          from (select seq, case when json_valid(value) then value else '0' end as value from {src})),
        decoded as (select o.seq, {last} from objects o left join json_each(o.value) e on true
          where o.whole group by o.seq having {ok})"""


_VALID_REPORTS = _with("report_requests") + f""", valid as (select * from report_requests
        where not (from_ts > to_ts) and len(receivers) > 0
          and len(list_filter(receivers, lambda r: not regexp_full_match(r, '{EMAIL_RE}'))) = 0)
"""

ORACLE: dict[str, str] = {
    "uptime_report": _with("hb_nulls") + _report("hb_nulls", True),
    "uptime_report_archive": _with("hb_nulls") + _report("hb_nulls", True),
    "uptime_report_capped": _with("hb_wide") + _report("hb_wide", False),
    "uptime_daily": _with("hb") + _daily(True),
    "export_report": _with("hb") + f""", r as ({_report("hb", True)})
        select row_number() over (order by doc_count desc, server_id) as order_number, server_id,
        uptime_ratio, {_fmt("start_ping_at")} as start_ping_at, {_fmt("last_ping_at")} as last_ping_at,
        doc_count as total_checks from r""",
    "heartbeat_latest": _with("hb") + ", " + _LATEST + """
        select server_id, status, ts as last_ping_at from latest""",
    "heartbeat_decode": _with("raw_messages") + _members("raw_messages", "server_id", "status", "timestamp") + """
        select seq, server_id, status, try_cast(replace(timestamp, 'Z', '') as timestamp) as ts
        from decoded where try_cast(replace(timestamp, 'Z', '') as timestamp) is not null""",
    "status_upsert": _UPSERT,
    "list_servers": _with("servers") + """select server_id, server_name, status, ipv4, created_at,
        metadata_updated_at, last_ping_at from servers where not is_deleted
        order by created_at desc, server_id limit 100 offset 20""",
    "list_servers_deep": _with("servers") + """, n as (
        select *, row_number() over (order by server_name, server_id) - 1 as position,
               count(*) over () as total from servers where not is_deleted)
        select server_id, server_name, status, ipv4, created_at, metadata_updated_at, last_ping_at
        from n where position >= greatest(0, total - 130) and position < greatest(0, total - 130) + 100""",
    "count_servers": _with("servers") + "select count(*) as total from servers where not is_deleted",
    "export_servers": _with("servers") + f""", page as (select * from servers where not is_deleted
        order by server_name, server_id limit 100)
        select row_number() over (order by server_name, server_id) as order_number, server_id,
        server_name, ipv4, status, {_fmt("created_at")} as created_at,
        {_fmt("metadata_updated_at")} as metadata_updated_at, {_fmt("last_ping_at")} as last_ping_at
        from page""",
    "page_requests_check": _with("page_requests") + """, c as (select *,
        case when sort_field is null or sort_field not in ('created_at', 'server_name')
                  then 'invalid sort field or order'
             when cast(to_row as bigint) - from_row <= 0 or from_row < 0 or to_row <= 0
                  then 'invalid pagination' end as error from page_requests)
        select req_id, cast(from_row as bigint) as from_row,
        cast(case when error is null and cast(to_row as bigint) - from_row > 100 then from_row + 100
             else to_row end as bigint) as to_row, error from c""",
    "report_requests_check": _with("report_requests") + f"""select req_id,
        case when from_ts > to_ts then 'invalid time range'
             when len(receivers) = 0 then 'invalid email'
             when len(list_filter(receivers, lambda r: not regexp_full_match(r, '{EMAIL_RE}'))) > 0
             then 'invalid email' end as error
        from report_requests""",
    "create_conflicts": "with recursive " + ", ".join(f"{n} as ({A[n]})" for n in ("creates", "servers"))
        + ", " + _greedy(f"select * from creates where regexp_full_match(ipv4, '{IPV4_RE}')",
                         "select server_id, server_name from servers") + f"""
        select c.server_id, case when not regexp_full_match(c.ipv4, '{IPV4_RE}') then 'invalid ipv4'
          when a.rn is not null then 'created' else 'duplicate server id or server name' end as outcome
        from creates c left join accepted a on c.rn = a.rn""",
    "patch_servers": _patched() + """
        select q.rn, q.server_id, s.outcome from q join (select distinct step, outcome from s) s
        on s.step = q.k""",
    "patch_registry": _patched() + """
        select server_id, server_name, ipv4, metadata_updated_at from s
        where step = (select max(step) from s)""",
    "soft_delete": _with("patches", "servers") + """select p.rn, p.server_id,
        case when a.server_id is not null
              and row_number() over (partition by p.server_id order by p.rn) = 1
             then 'deleted' else 'record not found' end as outcome
        from patches p
        left join (select server_id from servers where not is_deleted) a on p.server_id = a.server_id""",
    "delete_registry": _with("patches", "servers") + """select server_id, server_name,
        is_deleted or server_id in (select server_id from patches) as is_deleted from servers""",
    "monitored_set": _with("changelog") + """select server_id, seq from (
        select *, row_number() over (partition by server_id order by seq desc) as rk from changelog)
        where rk = 1 and op <> 'delete'""",
    "monitored_resync": _with("changelog") + """, r as (
        select unnest([0, max(seq) // 4, max(seq) * 2 // 4, max(seq) * 3 // 4]) as start,
               unnest([0, 1, 2, 3]) as period, max(seq) as top from changelog),
        e as (select period, start, coalesce(lead(start) over (order by period), top + 1) as stop from r),
        g as (select period, server_id,
            max(seq) filter (seq >= start) as last, max(seq) filter (seq >= start and op <> 'delete') as put,
            max(seq) filter (seq < start and op <> 'delete') as loaded
          from changelog join e on seq < stop group by period, server_id)
        select period, server_id, coalesce(put, loaded) as seq from g
        where case when last is null then loaded is not null else last = put end""",
    "monitored_registry": _with("servers") + """select server_id, server_name, ipv4 from servers
        where not is_deleted""",
    "import_rows": _with("imp_files") + """select file_id, rn from imp_files
        where file_id not in (select file_id from imp_files where ncell < 4)""",
    "import_ipv4_split": _with("imp_simple") + f"""select rn, server_id,
        coalesce(regexp_full_match(ipv4, '{IPV4_RE}'), false) as valid from imp_simple""",
    "import_merge": "with recursive " + _greedy(A["imp_chain"], A["registry_small"]) + f"""
        select i.rn, i.server_id, i.server_name,
        case when a.rn is not null then 'success' else 'duplicate server id or server name' end as outcome
        from ({A["imp_chain"]}) i left join accepted a on i.rn = a.rn""",
    "import_sheet_files": "with recursive " + ", ".join(
        f"{n} as ({A[n]})" for n in ("imp_simple", "servers")) + """, sheet as (
        select i.*, row_number() over (partition by i.rn // 100 order by i.rn) as row_no,
               row_number() over (order by cast(i.rn // 100 as varchar), i.rn) as k,
               coalesce(regexp_full_match(i.ipv4, '""" + IPV4_RE + """'), false) as valid
        from imp_simple i), """ + _greedy(
        "select k as rn, server_id, server_name from sheet where valid",
        "select server_id, server_name from servers") + """
        select s.row_no, s.server_id, s.server_name,
        case when not s.valid then 'invalid ipv4' when a.rn is not null then 'success'
             else 'duplicate server id or server name' end as outcome
        from sheet s left join accepted a on s.k = a.rn""",
    "sheet_roundtrip": _with("imp_simple") + """select rn // 100 as file_no,
        row_number() over (partition by rn // 100 order by rn) as row_no, server_id,
        case rn % 6 when 0 then concat('a"b, ', server_name) when 1 then concat('  ', server_name, ' ')
          when 2 then concat(server_name, chr(10), 'second line') when 3 then concat('"', server_name, '"')
          when 4 then concat(',', chr(92), server_name) else server_name end as server_name, ipv4
        from imp_simple""",
    "import_result_rows": "with recursive " + _greedy(
        f"select * from ({A['imp_simple']}) where regexp_full_match(ipv4, '{IPV4_RE}')", None) + f""",
        o as (select i.rn, i.server_id, case when a.rn is not null then 'success' else 'failed' end as class,
              not regexp_full_match(i.ipv4, '{IPV4_RE}') as late
              from ({A["imp_simple"]}) i left join accepted a on i.rn = a.rn)
        select class, row_number() over (partition by class order by late, rn) - 1 as position, server_id
        from o""",
    "import_new_rows": "with recursive " + _greedy(
        f"select * from ({A['imp_simple']}) where regexp_full_match(ipv4, '{IPV4_RE}')", None) + f"""
        select i.server_id, i.server_name, i.ipv4, 'UNKNOWN' as status,
        timestamp '{C.PATCH_AS_OF}' as created_at, false as is_deleted
        from ({A["imp_simple"]}) i join accepted a on i.rn = a.rn""",
    "import_summary": "with recursive " + _greedy(
        f"select * from ({A['imp_simple']}) where regexp_full_match(ipv4, '{IPV4_RE}')", None) + f"""
        select case when a.rn is not null then 'success' else 'failed' end as outcome,
        count(*) as total from ({A["imp_simple"]}) i left join accepted a on i.rn = a.rn
        group by 1""",
    "probe_requests": _with("servers") + f"""select unnest(generate_series(
          timestamp '{C.PROBE_FROM}', timestamp '{C.PROBE_TO}',
          interval '{C.PROBE_CYCLE_SECONDS}' second)) as tick,
        server_id, server_name, ipv4 as ip from servers where not is_deleted""",
    "classify_probe": _with("probe_results") + """select seq, server_id,
        case when error is null and packets_recv > 0 then 'on' else 'off' end as status
        from probe_results""",
    "probe_messages": _with("servers") + f"""select unnest(generate_series(
          timestamp '{C.PROBE_FROM}', timestamp '{C.PROBE_TO}',
          interval '{C.PROBE_CYCLE_SECONDS}' second)) as tick,
        concat('{{"ServerID":"', server_id, '","ServerName":"', server_name, '","IP":"', ipv4, '"}}') as value
        from servers where not is_deleted""",
    "probe_request_decode": _with("probe_log") + _members("probe_log", "ServerID", "ServerName", "IP") + """
        select seq, ServerID as server_id, ServerName as server_name, IP as ip from decoded""",
    "probe_heartbeats": _with("probe_log", "probe_results") + _members("probe_log", "ServerID", "ServerName", "IP")
        + """ select d.seq, ServerID as server_id,
        case when error is null and packets_recv > 0 then 'on' else 'off' end as status, probed_at as ts
        from decoded d join probe_results p on d.seq = p.seq""",
    "mail_outbox": _VALID_REPORTS + """select req_id, unnest(receivers) as receiver,
        'Server uptime report' as subject, 'Please find the attached report.' as body,
        concat('report-', cast(req_id as varchar), '.csv') as filename from valid""",
    "mail_messages": _VALID_REPORTS + """select req_id, '' as sender,
        array_to_string(receivers, '|') as receivers, 'Server uptime report' as subject,
        'Please find the attached report.' as body,
        concat('report-', cast(req_id as varchar), '.csv') as filename, '' as data from valid""",
    "attachment_names": _with("mail_files") + """select concat('/store/2024/', filename) as path, filename
        from mail_files""",
    "mail_ready": _with("mail_items", "mail_files") + """select i.mail_id,
        bool_and(f.filename is not null) as ready
        from mail_items i left join mail_files f on i.filename = f.filename group by i.mail_id""",
    # the text is judged: valid JSON whose parts have the types of a mail
    "mail_stream": _with("raw_mails", "mail_files") + """, m as (
        select seq, json_extract(value, '$.Mail') as mail from raw_mails where json_valid(value)),
        good as (select seq, json_extract(mail, '$.Attachments') as items from m
          where coalesce(json_type(mail, '$.To'), 'ARRAY') = 'ARRAY'
            and coalesce(json_type(mail, '$.Attachments'), 'ARRAY') = 'ARRAY'),
        items as (select seq, json_type(unnest(json_extract(items, '$[*].Filename'))) as type,
                         unnest(json_extract_string(items, '$[*].Filename')) as filename from good)
        select g.seq as mail_id, coalesce(bool_and(f.filename is not null) filter (i.seq is not null), true) as ready
        from good g left join items i on g.seq = i.seq left join mail_files f on i.filename = f.filename
        group by g.seq having coalesce(bool_and(i.type = 'VARCHAR'), true)""",
    "heartbeat_archive": _with("hb") + "select seq, server_id, status, ts, cast(ts as date) as dt from hb",
    "status_stream": _UPSERT,
    "status_compacted": _UPSERT,
    "uptime_stream": _with("hb") + _daily(True),
    "attachment_listing": _with("imp_simple") + "select distinct rn // 100 as file_no, 'csv' as kind from imp_simple",
    "archive_once": _with("hb") + "select seq, server_id, status, ts, cast(ts as date) as dt from hb",
    "archive_from_latest": _with("hb") + """select seq, server_id, status, ts, cast(ts as date) as dt from hb
        where seq > (select max(seq) // 2 from hb)""",
    "status_bucketed": _UPSERT,
    "status_changes": _with("hb") + ", " + _LATEST + " select server_id, status from latest",
    "probe_stream": _with("servers") + f""", t as (
        select timestamp '{C.PROBE_FROM}' + to_seconds(i * (cast(epoch(max(created_at) - timestamp '{C.PROBE_FROM}') as bigint) // 4))
          as tick from servers, (select unnest([0, 1, 2, 3]) as i) group by i)
        select tick, concat('{{"ServerID":"', server_id, '","ServerName":"', server_name, '","IP":"', ipv4, '"}}') as value
        from t join servers on created_at <= tick
          and not (is_deleted and created_at + interval 30 minute <= tick)""",
}
ORACLE["list_servers_paged"] = ORACLE["list_servers_deep"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
