"""The same results as the catalog queries, in ANSI SQL over the sample tables.

Written from the rules' meaning alone (global window functions, joins and a recursive chain), so that
they check the distributed plans independently.
"""

from __future__ import annotations

RULES = """
rules(rule_id, rule_name, severity, description, prefix, suffix, shows) as (values
  ('hi', 'High value', 'critical', 'above 100 <hot> & rising', '', ' > 100', 'measure'),
  ('errs', 'Errors', 'warning', '', 'event_type ~ "err" -> ', '', 'bool'),
  ('buy', 'Big purchase', 'info', '', 'record.event_type == "purchase" && record.value > 60 -> ', '', 'bool'),
  ('peak', 'Hourly peak', 'info', '', 'max(value,1h0m0s)=', ' > 150', 'measure'))
"""
TICKS = """
peak_ticks as (
  select i::bigint as tick, timestamp '2024-01-01' + i * interval 15 minute as tick_at
  from generate_series(0, 2880) g(i)),
peak as (
  select tick, tick_at, max(value) as m from peak_ticks left join events
  on ts between tick_at - interval 1 hour and tick_at group by tick, tick_at)
"""
VERDICTS = f"""
{RULES}, {TICKS},
verdicts as (
  select 'hi' as rule_id, ts as now, event_id as seq, value > 100 as trig, value as m from events
  union all select 'errs', ts, event_id, contains(event_type, 'err'), 1 from events
  union all select 'buy', ts, event_id, event_type = 'purchase' and value > 60, 1 from events
  union all select 'peak', tick_at, tick, coalesce(m > 150, false), m from peak)
"""


def value_text(trig: str, m: str) -> str:
    number = f"regexp_replace(({m})::varchar, '\\.0$', '')"
    return (f"case when {m} is null then '' when shows = 'bool' then prefix || ({trig})::varchar || suffix "
            f"else prefix || {number} || suffix end")


INCIDENTS = f"""
{VERDICTS},
changes as (
  select *, lag(trig, 1, false) over (partition by rule_id order by now, seq) as before from verdicts),
edges as (
  select *, lead(now) over w as next_now, lead(seq) over w as next_seq, lead(m) over w as next_m
  from changes where trig <> before window w as (partition by rule_id order by now, seq)),
inc as (
  select sha256(rule_id || '|' || epoch_us(now)::varchar || '|' || seq::varchar) as incident_id, rule_id,
         now as open_at, seq as open_seq, m as open_m, next_now as close_at, next_seq as close_seq, next_m as close_m
  from edges where trig)
"""
INCIDENT_TABLE = f"""
{INCIDENTS},
incidents as (
  select incident_id as id, rule_id, date_trunc('millisecond', open_at) as triggered_at,
         date_trunc('millisecond', close_at) as resolved_at, {value_text('true', 'open_m')} as last_value
  from inc join rules using (rule_id))
"""
MS = "date_trunc('millisecond', {0})"
DELIVERY = f"""
{INCIDENTS},
policy(rule_id, subscription_id, subscriber_id, dwell, rep, on_resolve, one_shot) as (values
  ('hi', 's-direct', 'ann', 0, 0, true, false),
  ('hi', 's-ops', 'ann', 300, 600, true, false), ('errs', 's-ops', 'ann', 300, 600, true, false),
  ('peak', 's-ops', 'ann', 300, 600, true, false),
  ('hi', 's-prod', 'bob', 120, 0, false, false),
  ('hi', 's-once', 'bob', 0, 0, true, true), ('errs', 's-once', 'bob', 0, 0, true, true),
  ('peak', 's-once', 'bob', 0, 0, true, true),
  ('peak', 's-peak', 'bob', 1200, 2700, true, false),
  ('hi', 's-untiered', 'cal', 0, 1800, true, false), ('errs', 's-untiered', 'cal', 0, 1800, true, false)),
clock as (select distinct rule_id, dwell, rep from policy),
firing as (
  select v.rule_id, v.now, v.seq, v.m, i.incident_id, i.open_at, i.open_seq
  from (
    select *, last_value(case when trig and not before then now end ignore nulls)
             over (partition by rule_id order by now, seq rows between unbounded preceding and current row) as began
    from changes) v
  join inc i on i.rule_id = v.rule_id and i.open_at = v.began where v.trig),
firsts as (
  select incident_id, c.rule_id, open_at, dwell, rep, min(now) as now, arg_min(seq, now) as seq, arg_min(m, now) as m
  from firing f join clock c using (rule_id)
  where (now = open_at and dwell <= 0)
     or (now > open_at and now >= date_trunc('millisecond', open_at) + dwell * interval 1 second)
  group by all),
"""
CHAIN = f"""
{DELIVERY}
hops as (
  select f.incident_id, c.dwell, c.rep, f.now,
         min(g.now) as nxt
  from firing f join clock c on c.rule_id = f.rule_id and c.rep > 0
  join firing g on g.incident_id = f.incident_id
   and g.now >= date_trunc('millisecond', f.now) + c.rep * interval 1 second
  group by all),
chain as (
  select incident_id, dwell, rep, now from firsts where rep > 0
  union all
  select h.incident_id, h.dwell, h.rep, h.nxt from chain c join hops h
  on h.incident_id = c.incident_id and h.dwell = c.dwell and h.rep = c.rep and h.now = c.now),
repeats as (
  select c.incident_id, f.rule_id, f.open_at, c.dwell, c.rep, c.now, f.seq, f.m
  from chain c join firing f on f.incident_id = c.incident_id and f.now = c.now
  anti join firsts s on s.incident_id = c.incident_id and s.dwell = c.dwell and s.rep = c.rep and s.now = c.now),
events_out as (
  select incident_id, rule_id, open_at, dwell, rep, 'firing' as kind, now, seq, m from firsts
  union all select incident_id, rule_id, open_at, dwell, rep, 'repeat', now, seq, m from repeats
  union all select f.incident_id, f.rule_id, f.open_at, f.dwell, f.rep, 'resolved', i.close_at, i.close_seq, i.close_m
  from firsts f join inc i using (incident_id) where i.close_at is not null),
dispatched as (
  select e.incident_id, e.rule_id, e.open_at, p.subscription_id, p.subscriber_id, p.one_shot, e.kind, e.now, e.seq, e.m
  from events_out e join policy p on p.rule_id = e.rule_id and p.dwell = e.dwell and p.rep = e.rep
  where e.kind <> 'resolved' or p.on_resolve)
"""
SEND = f"""
{CHAIN},
bind(subscription_id, channel, type, address, destination, failed) as (values
  ('s-direct', 'mail', 'smtp', 'ann@example.org', 'ann@example.org', false),
  ('s-direct', 'hook', 'slack', '', 'http://hooks/default', false),
  ('s-ops', 'mail', 'smtp', 'ann@example.org', 'ann@example.org', false),
  ('s-ops', 'hook', 'slack', '', 'http://hooks/default', false),
  ('s-prod', 'mail', 'smtp', 'bob@example.org', 'bob@example.org', false),
  ('s-once', 'mail', 'smtp', 'bob@example.org', 'bob@example.org', false),
  ('s-once', 'pager', 'pagerduty', ' KEY-1 ', 'KEY-1', false),
  ('s-once', 'card', 'teams', '', 'http://cards/default', false),
  ('s-peak', 'pager', 'pagerduty', ' KEY-1 ', 'KEY-1', false),
  ('s-peak', 'card', 'teams', '', 'http://cards/default', false),
  ('s-untiered', 'text', 'sms', '', null, true),
  ('s-untiered', 'web', 'webhook', 'http://cal', 'http://cal', false),
  ('s-untiered', 'chat', 'discord', '', 'http://chat/default', false)),
deliveries as (
  select * from dispatched where not one_shot
  union all
  select * from (select * from dispatched where one_shot
                 qualify row_number() over (partition by subscription_id order by now, seq, rule_id) = 1)),
sent as (
  select d.*, b.channel, b.type, b.address, b.destination, b.failed, r.rule_name, r.severity, r.description,
         {value_text("kind <> 'resolved'", 'm')} as value
  from deliveries d join bind b using (subscription_id) join rules r using (rule_id))
"""
RFC = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
TITLE = "'[' || upper(kind) || '] ' || rule_name"
NOW3339 = RFC.format("now")


def _color(names: tuple) -> str:
    done, crit, warn, other = names
    return (f"case when kind = 'resolved' then {done} when severity = 'critical' then {crit} "
            f"when severity = 'warning' then {warn} else {other} end")


HEX = ("'2EB67D'", "'E01E5A'", "'ECB22E'", "'439FE0'")
INT = (str(0x2EB67D), str(0xE01E5A), str(0xECB22E), str(0x439FE0))

PAYLOADS = {
    "slack": ("slack", f"""json_object(
        'text', case kind when 'resolved' then ':white_check_mark:' when 'repeat' then ':repeat:'
                else ':rotating_light:' end || ' *[' || upper(severity) || ']* `' || upper(kind) || '` — '
                || rule_name || chr(10) || '>' ||
                replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
        'attachments', json_array(json_object(
            'color', {_color(("'good'", "'danger'", "'warning'", "'#439FE0'"))},
            'fields', json_array(json_object('title', 'Value', 'value', value, 'short', true),
                                 json_object('title', 'Incident', 'value', incident_id, 'short', true)),
            'ts', epoch_us(now) // 1000000)))"""),
    "webhook": ("webhook", f"""json_object(
        'incident_id', incident_id, 'rule_id', rule_id, 'rule_name', rule_name, 'severity', severity,
        'description', description, 'value', value, 'kind', kind, 'now', {NOW3339}, 'triggered_at', {NOW3339})"""),
    "pagerduty": ("pagerduty", f"""case when kind = 'resolved' then json_object(
        'routing_key', destination, 'event_action', 'resolve', 'dedup_key', 'klaxon:' || incident_id)
      else json_object(
        'routing_key', destination, 'event_action', 'trigger', 'dedup_key', 'klaxon:' || incident_id,
        'payload', json_object(
            'summary', {TITLE} || case when value <> '' then ' — ' || value else '' end, 'source', rule_id,
            'severity', severity, 'timestamp', {NOW3339}, 'component', 'klaxon-rule', 'group', rule_id, 'class', kind,
            'custom_details', json_object('rule_id', rule_id, 'rule_name', rule_name, 'incident_id', incident_id,
                                          'value', value, 'description', description))) end"""),
    "teams": ("teams", f"""'{{"@type":"MessageCard","@context":"https://schema.org/extensions","summary":"' || {TITLE}
        || '","themeColor":"' || {_color(HEX)} || '","title":"' || {TITLE} || '","text":"' || description
        || '","sections":[{{"facts":[{{"name":"Rule","value":"' || rule_name || '"}},{{"name":"Kind","value":"'
        || upper(kind) || '"}},{{"name":"Severity","value":"' || upper(severity) || '"}}'
        || case when value <> '' then ',{{"name":"Value","value":"' || replace(value, '"', '\\"') || '"}}' else '' end
        || ',{{"name":"Incident","value":"' || incident_id || '"}},{{"name":"Triggered","value":"' || {NOW3339}
        || '"}}]}}]}}'"""),
    "discord": ("discord", f"""'{{"username":"klaxon","embeds":[{{"title":"' || {TITLE} || '","color":' || {_color(INT)}
        || case when description <> '' then ',"description":"' || description || '"' else '' end
        || ',"fields":[{{"name":"Rule","value":"' || rule_name || '","inline":true}},{{"name":"Severity","value":"'
        || upper(severity) || '","inline":true}}'
        || case when value <> '' then ',{{"name":"Value","value":"' || replace(value, '"', '\\"') || '","inline":true}}'
           else '' end
        || ',{{"name":"Incident","value":"' || incident_id || '","inline":true}}],"timestamp":"' || {NOW3339} || '"}}]}}'"""),
    "sms": ("sms", """'[' || upper(severity) || '/' || upper(kind) || '] ' || rule_name
        || case when value <> '' then ' — ' || value else '' end
        || case when description <> '' then ' — ' || description else '' end || ' — inc:' || incident_id"""),
    "email": ("smtp", f"""json_object('subject', '[' || upper(kind) || '] ' || upper(severity) || ': ' || rule_name, 'body',
        'Rule:        ' || rule_name || chr(10) || 'Severity:    ' || severity || chr(10) ||
        'State:       ' || kind || chr(10) || 'Value:       ' || value || chr(10) ||
        'Incident:    ' || incident_id || chr(10) || 'Triggered:   ' || {NOW3339} || chr(10) || chr(10) ||
        description || chr(10))"""),
}

SUBS = """
parts as (
  select 'rule-' || p_partkey as id, case when p_size = 7 then '' else p_name end as name, p_brand as brand,
         p_size::varchar as size, p_type as type, case when p_size < 50 then 'std' else '' end as tier,
         p_size, p_type, p_brand, p_size % 2 = 0 as enabled from part),
people as (select 'cust-' || c_custkey as id, * from customer where c_acctbal > 0),
subs as (
  select 'sub-' || o_orderkey as id, 'cust-' || o_custkey as subscriber_id, o_orderstatus as st, o_orderpriority as pr,
         case when o_orderstatus = 'O' then 'rule-' || o_custkey end as rule_id,
         'Brand#' || (o_custkey % 25 + 1) as brand, (o_orderkey % 50 + 1)::varchar as size,
         case when o_orderpriority = '5-LOW' then -1 else 0 end as dwell_ns, o_orderpriority = '2-HIGH' as one_shot
  from orders)
"""
DIRECT = "select p.id as rule_id, s.id as subscription_id from subs s join parts p on p.id = s.rule_id"
LABELS = """
select p.id as rule_id, s.id as subscription_id from subs s join parts p
  on s.st = 'P' and p.brand = s.brand and p.size = s.size
union all select p.id, s.id from subs s join parts p
  on s.st = 'F' and s.pr = '1-URGENT' and p.tier = ''
union all select p.id, s.id from subs s join parts p
  on s.st = 'F' and s.pr <> '1-URGENT' and p.brand = s.brand and p.tier = ''
"""


def _fan_out(fax: bool) -> str:
    known = "true" if fax else "channel <> 'fax'"
    return f"""with {SUBS},
    b as (
      select s.id as subscription_id, unnest([
               {{'channel': p.c_mktsegment, 'address': p.c_name}}, {{'channel': 'NATION_' || p.c_nationkey, 'address': ''}},
               {{'channel': 'fax', 'address': '1'}}], recursive := true), s.pr
      from subs s join people p on p.id = s.subscriber_id),
    u as (select *, ({known}) and (pr <> '3-MEDIUM' or channel in ('BUILDING', 'fax')) as ok from b)
    select subscription_id, channel, address,
           (select count(*) from u x where x.subscription_id = u.subscription_id and not x.ok)::bigint as skipped
    from u where ok"""


def _messages() -> str:
    return """msgs as (
  select 'q-' || event_type as input_ref, case event_type when 'error' then '[' || user_id || ']' when 'view' then 'null'
         when 'signup' then '' else props end as body, ts as "when", event_id as seq, event_type, props from events)"""


def _window(agg: str) -> str:
    fn = {"count": "count(value)::double"}.get(agg, f"{agg}(value)")
    return f"""with t as (select timestamp '2024-01-01' + i * interval 20 minute as now from generate_series(0, 2160) g(i))
    select 'w' as rule_id, now, round({fn}, 9) as value from t left join events
    on ts between now - interval 90 minute and now group by now"""


def _push(*rules: tuple[str, str]) -> str:
    return " union all ".join(
        f"select '{i}' as rule_id, ts as now, event_id as seq, {test} as triggered from events" for i, test in rules)


def _changes() -> str:
    return """
log as (
  select o_custkey as id, case o_orderstatus when 'O' then 'update' when 'P' then 'create' else 'delete' end as op,
         o_orderkey as version, o_orderdate as at, 'v' || o_orderkey as name
  from orders),
base as (select c_custkey as id, c_name as name, timestamp '2024-01-01' as at from customer where c_acctbal > 5000)
"""


APPLY = f"""
with recursive {_changes()},
steps as (select *, row_number() over (partition by id order by version) as n from log),
ids as (select id from base union select id from log),
fold as (
  select ids.id, 0::bigint as n, b.name, b.at as created_at, b.at as updated_at, false as rejected, null::bigint as version
  from ids left join base b using (id)
  union all
  select s.id, s.n,
         case when op = 'delete' then null when op = 'create' and f.created_at is not null then f.name
              when op = 'update' and f.created_at is null then null else s.name end,
         case when op = 'delete' then null when f.created_at is not null then f.created_at
              when op = 'create' then s.at end,
         case when op = 'delete' then null when op = 'create' and f.created_at is not null then f.updated_at
              when op = 'update' and f.created_at is null then null else s.at end,
         op = 'create' and f.created_at is not null, s.version
  from fold f join steps s on s.id = f.id and s.n = f.n + 1)
"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_events"] = """select coalesce(nullif(case when event_type = 'view' then '' else event_type end, ''), 'events')
        as input_ref, ts as "when", event_id as seq, user_id, value from events"""
    q["src_json_decode"] = f"""with {_messages()} select input_ref, "when", seq, (props->>'k')::bigint as k from msgs
        where event_type in ('click', 'purchase')"""
    q["src_quarantine"] = f"""with {_messages()} select input_ref, body, "when", seq,
        case when event_type = 'signup' then 'empty' else 'not an object' end as reason from msgs
        where event_type not in ('click', 'purchase')"""
    q["src_kafka_shape"] = """select event_type as input_ref, ts as "when", event_id * 1024 + user_id % 4 as seq, value,
        event_type as kind from events"""
    q["src_queue"] = """select event_type as input_ref, ts as "when", event_id as seq, (props->>'k')::bigint as k from events"""
    q["src_scrape"] = """select event_type as input_ref, ts as "when", event_id as seq, (props->>'k')::bigint as value,
        event_type as source from events where value <= 100 and event_type in ('click', 'error', 'purchase')"""
    q["coerce_numeric"] = "select event_id as seq, case when event_type = 'click' then value end as x from events"
    q["coerce_string"] = r"""select event_id as seq, case event_type when 'click' then regexp_replace(value::varchar, '\.0$', '')
        when 'view' then value::varchar when 'signup' then (value > 50)::varchar when 'error' then '<nil>' end as x from events"""
    q["op_compare"] = "select event_id, " + ", ".join(
        f"case when event_type = 'error' then {nan} else value {op} 34.59 end as {n}" for n, op, nan in (
            ("gt", ">", "false"), ("gte", ">=", "false"), ("lt", "<", "false"), ("lte", "<=", "false"),
            ("eq", "=", "false"), ("neq", "<>", "true"))) + " from events"
    for name, op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>")):
        q["threshold_" + name] = _push((f"events-{name}", f"value {op} 34.59"), (f"text-{name}", "false")) + f"""
            union all select 'orders-{name}', o_orderdate, o_orderkey, o_totalprice {op} 250000 from orders"""
    q["pattern_contains"] = _push(("err", "contains(event_type, 'r')"), ("num", "contains(user_id::varchar, '42')"),
                                  ("missing", "false"))
    q["pattern_regex"] = _push(
        ("re", "regexp_matches(event_type, '^(c|p).*[ke]$')"), ("all", "true"),
        ("digits", r"regexp_matches(value::varchar, '\.5$')"))
    q["expression_push"] = _push(
        ("and", "event_type = 'error' and value > 20"), ("or", "value >= 200 or event_type = 'signup'"), ("absent", "false"))
    q["expression_regex_match"] = _push(("m", "regexp_matches(event_type, '^(cl|vi)')"), ("none", "false"))
    q["expression_builtins"] = "select * from (" + _push(
        ("len", "length(event_type) > 5"), ("lower", "event_type = 'click'"), ("in", "event_type in ('click', 'view')"),
        ("starts", "event_type like 'p%'"), ("ends", "event_type like '%r'"), ("contains", "event_type like '%ie%'"),
        ("matches", "event_type = 'signup'"), ("case", "event_type = 'view' and value > 50"),
        ("math", "case when user_id = 0 then value > 0 else value / user_id > 1.5 end")) + ") where triggered is not null"
    q["expression_fields"] = "select * from (" + _push(
        ("eq", "event_type in ('click', 'signup', 'error')"), ("ne", "event_type in ('view', 'purchase')"),
        ("lt", "case when event_type in ('click', 'view', 'signup') then event_type = 'view' end")) + ") where triggered is not null"
    q["expression_invalid"] = """select 'good' as rule_id, false as invalid, count(*)::bigint as ticks,
        count(*) filter (value > 100)::bigint as hits from events
        union all select unnest(['syntax', 'number', 'unknown', 'nested']), true, 0, 0"""
    from .catalog import DIALECT

    q["pattern_dialect"] = _push(*((f"p{i}", f"regexp_matches(event_type, '{p}')") for i, p in enumerate(DIALECT)),
                                 ("end", "event_type = 'signup' and regexp_matches(event_type || chr(10), 'p$')"),
                                 ("dot", "event_type = 'signup' and regexp_matches(event_type || chr(10), 'p.$')"))
    q["expression_push_window_zero"] = _push(("zero", "true"), ("mixed", "value > 100"))
    q["rule_routing"] = """select event_type as input_ref, ts as "when", event_id as seq, rule_id from events
        join (values ('a', 'click'), ('b', 'click'), ('d', 'error'), ('e', 'none')) r(rule_id, ref) on ref = event_type"""
    q["table_rules"] = """select n_name as rule_id, count(*)::bigint as ticks,
        count(*) filter (case when n_regionkey < 3 then value > n_nationkey * 10
                         else contains(event_type, lower(substr(n_name, 5, 1))) end)::bigint as hits
        from nation cross join events where n_regionkey <> 2 group by n_name"""
    q["observe_samples"] = """select 'events' as input_ref, 'value' as field, ts as at, value as v from events
        union all select 'events', 'user_id', ts, user_id::double from events"""
    q["schedule_grid"] = """with r as (select min(ts) a, max(ts) b from events), s(rule_id, every) as
        (values ('ten', 600), ('odd', 91))
        select rule_id, i::bigint as tick, a + i * every * interval 1 second as now
        from r, s, generate_series(0, 400000) g(i) where a + i * every * interval 1 second <= b"""
    for agg in ("avg", "sum", "min", "max", "count"):
        q["win_" + agg] = _window(agg)
    hours = "select timestamp '2024-01-01' + i * interval 1 hour as now from generate_series(0, 720) g(i)"
    q["win_boundary"] = f"""with t as ({hours}) select 'w' as rule_id, now, count(value)::bigint as n from t left join events
        on date_trunc('hour', ts) between now - interval 3 hour and now group by now"""
    q["win_max_span"] = f"""with t as ({hours}) select 'w' as rule_id, now, count(value)::bigint as n from t left join events
        on date_trunc('hour', ts) > now - interval 6 hour and date_trunc('hour', ts) <= now group by now"""
    q["window_aggregate_rule"] = f"""with {TICKS}, quiet as (
          select timestamp '2024-01-01' + i * interval 30 minute as tick_at from generate_series(0, 1440) g(i)),
        quiet_max as (select tick_at, max(value) as m from quiet left join events
                      on ts between tick_at - interval 2 minute and tick_at group by tick_at)
        select 'peak' as rule_id, tick_at as now, coalesce(m > 150, false) as triggered, m as measure from peak
        union all select 'quiet', tick_at, coalesce(m < 20, false), m from quiet_max"""
    q["expression_scheduled"] = """with t as (
          select timestamp '2024-01-01' + i * interval 30 minute as now from generate_series(0, 1440) g(i)),
        a as (select now, max(value) as m, count(value) filter (ts >= now - interval 30 minute) as n
              from t left join events on ts between now - interval 1 hour and now group by now)
        select 'both' as rule_id, now, coalesce(m, 0) > 150 and n < 100 as triggered from a
        union all select 'no-data', timestamp '2024-01-01' + i * interval 6 hour, true from generate_series(0, 120) g(i)
        union all select 'stub', timestamp '2024-01-01' + i * interval 12 hour, false from generate_series(0, 60) g(i)
        union all select 'bad', timestamp '2024-01-01' + i * interval 12 hour, true from generate_series(0, 60) g(i)"""
    six = "t as (select timestamp '2024-01-01' + i * interval 6 hour as now from generate_series(0, 120) g(i))"
    ten = "t as (select timestamp '2024-01-01' + i * interval 10 minute as now from generate_series(0, 4320) g(i))"
    q["win_long"] = f"""with {ten}, a as (select now, avg(value) as av, sum(value) as su, min(value) as mi, max(value) as ma,
          count(value)::double as n from t left join (select ts, round(value * 100) as value from events) e
          on ts between now - interval 20 day and now group by now)
        select rule_id, now, v from (select now, unnest(['avg', 'sum', 'min', 'max', 'count']) as rule_id,
          unnest([av, su, mi, ma, n]) as v from a)"""
    q["expression_ratio"] = f"""with {six}, n as (select now, count(value) as n from t left join events
          on ts between now - interval 1 day and now group by now)
        select 'none' as rule_id, now, false as triggered from t union all select 'infinite', now, n > 0 from n
        union all select 'one', now, false from t"""
    months = """b as (select date_trunc('month', min(o_orderdate)) as a, max(o_orderdate) as z from orders),
        m as (select a + to_months(i::int) as now from b, generate_series(0, 1200) g(i) where a + to_months(i::int) <= z),
        late as (select now, count(o_orderkey)::bigint as n from m left join orders on o_orderstatus = 'P'
                 and o_orderdate < now and o_orderdate >= now - interval 30 day group by now),
        anyn as (select count(*)::bigint as n from orders where o_totalprice > 499000)"""
    q["sql_count_rows"] = "select count(*)::bigint as n from orders where o_totalprice > 400000"
    q["sql_returns_rows"] = f"""with {months} select 'late' as rule_id, now, n >= 60 as triggered, n from late
        union all select 'any', now, n >= 1, n from m, anyn"""
    q["sql_isolated"] = f"""with {months}, middle as (select now as mid from m order by now limit 1 offset (select count(*) // 2 from m)),
        fragile as (select now, count(o_orderkey)::bigint as n from m cross join middle left join orders on o_orderdate < now
                    and o_totalprice / nullif(date_diff('day', mid, now), 0) > 1000 group by now)
        select 'late' as rule_id, now, n >= 60 as triggered, n, false as failed from late
        union all select 'any', now, n >= 1, n, false from m, anyn
        union all select 'fragile', now, n >= 50, n, false from fragile, middle where now <> mid
        union all select 'fragile', mid, false, -1, true from middle
        union all select 'lost', now, false, -1, true from m"""
    q["live_state_errors"] = f"""with {months},
        v as (select 'late' as rule_id, now, n >= 60 as trig, n, 60 as need from late
              union all select 'any', now, n >= 1, n, 1 from m, anyn),
        l as (select rule_id, arg_max(trig, now) as trig, arg_max(n, now) as n, any_value(need) as need,
                     max(now) as last_at from v group by rule_id),
        f as (select rule_id, max(now) filter (not trig) as last_false from v group by rule_id)
        select l.rule_id, case when trig then 'firing' else 'ok' end as state,
               case when trig then (select min(now) from v where v.rule_id = l.rule_id and
                    (f.last_false is null or v.now > f.last_false)) end as triggered_at,
               last_at as last_eval_at, 'rows=' || n || ' (>=' || need || '?)' as last_value, false as failed
        from l join f on f.rule_id = l.rule_id
        union all select 'lost', 'ok', null, (select max(now) from m), '', true"""
    q["transitions"] = f"""with {INCIDENTS}
        select rule_id, incident_id, open_at as now, 'ok' as prev, 'firing' as next, {value_text('true', 'open_m')} as value
        from inc join rules using (rule_id)
        union all select rule_id, incident_id, close_at, 'firing', 'ok', {value_text('false', 'close_m')}
        from inc join rules using (rule_id) where close_at is not null"""
    q["incidents"] = f"with {INCIDENT_TABLE} select * from incidents"
    q["live_states"] = f"""with {INCIDENTS},
        l as (select rule_id, arg_max(trig, (now, seq)) as trig, arg_max(m, (now, seq)) as m, max(now) as last_at
              from verdicts group by rule_id)
        select l.rule_id, case when trig then 'firing' else 'ok' end as state,
               date_trunc('millisecond', i.open_at) as triggered_at, date_trunc('millisecond', last_at) as last_eval_at,
               {value_text('trig', 'm')} as last_value, i.incident_id
        from l join rules using (rule_id) left join inc i on i.rule_id = l.rule_id and i.close_at is null"""
    q["match_direct"] = f"with {SUBS} {DIRECT}"
    q["match_labels"] = f"with {SUBS} {LABELS}"
    q["match_subscriptions"] = f"""with {SUBS}, m as ({DIRECT} union all {LABELS})
        select m.rule_id, subscription_id, one_shot, dwell_ns::bigint as dwell_ns from m join subs on subs.id = subscription_id"""
    q["subscriber_lookup"] = f"""with {SUBS} select id as subscription_id, subscriber_id from subs
        where subscriber_id not in (select id from people)"""
    q["channel_fanout"] = _fan_out(True)
    q["channel_configured"] = _fan_out(False)
    q["channel_destination"] = """with c as (
          select *, case when c_acctbal < 0 then ' ' when c_acctbal < 3000 then '' else ' ' || c_name end as a,
                 case when c_nationkey < 12 then 'http://default' end as d from customer),
        t as (select c_custkey, case c_mktsegment when 'AUTOMOBILE' then coalesce(nullif(a, ''), d)
                 when 'HOUSEHOLD' then nullif(trim(a), '') when 'MACHINERY' then nullif(a, '')
                 else coalesce(nullif(trim(a), ''), d) end as destination from c)
        select *, destination is null as failed from t"""
    problems = f"""with {SUBS}, c as (
          select *, case p_type when 'ECONOMY' then p_size < 20 else p_type in ('MEDIUM', 'PROMO') end as scheduled from parts),
        e as (select id, list_filter([
          case when name = '' then 'a rule needs a name' end,
          case when scheduled and p_size < 15 then 'a scheduled rule needs a schedule above zero' end,
          case when p_brand = 'Brand#1' then 'unknown severity' end,
          case when p_type = 'STANDARD' then 'unknown condition type mystery' end,
          case when p_type = 'LARGE' and p_size < 10 then 'pattern_match names no field' end,
          case when p_type = 'SMALL' and p_size < 10 then 'unknown comparison =>' end,
          case when p_type = 'MEDIUM' and p_size <= 20 then 'window_aggregate needs a window above zero' end,
          case when p_type = 'MEDIUM' and p_size < 10 then 'window_aggregate knows no aggregate median' end,
          case when p_type = 'LARGE' and p_size > 40 then 'pattern_match: regular expression' end,
          case when p_type = 'PROMO' and p_size < 25 then 'sql_returns_rows names no data source' end,
          case when p_type = 'PROMO' then 'sql_returns_rows has no query' end,
          case when p_type = 'ECONOMY' and p_size >= 20 and p_size < 30 then 'expression knows no mode later' end],
          lambda x: x is not null) as errors from c)"""
    q["validate_rules"] = problems + """ select id, len(errors)::int as n, case
        when errors[1] = 'pattern_match: regular expression' then 'pattern_match: missi'
        else substr(coalesce(errors[1], ''), 1, 20) end as first_error from e"""
    q["rule_decode"] = f"""with {SUBS} select id,
        case p_type when 'SMALL' then 'threshold' when 'MEDIUM' then 'window_aggregate' when 'LARGE' then 'pattern_match'
             when 'PROMO' then 'sql_returns_rows' when 'ECONOMY' then 'expression' else 'mystery' end as condition_type,
        case when p_type in ('MEDIUM', 'PROMO') or (p_type = 'ECONOMY' and p_size < 20) then 'scheduled' else 'push' end as mode,
        case p_brand when 'Brand#1' then 'urgent' when 'Brand#2' then 'info' else 'warning' end as severity,
        case when p_type in ('SMALL', 'MEDIUM') then 'value' when p_type = 'LARGE' then
             case when p_size < 10 then '' else 'msg' end end as field,
        case p_type when 'SMALL' then case when p_size < 10 then '=>' else '>' end when 'MEDIUM' then '<' end as op,
        case when p_type = 'MEDIUM' then ((p_size - 20) * 1000000)::bigint end as window_ns,
        case p_type when 'SMALL' then p_size::double when 'MEDIUM' then 5.0 end as value from parts"""
    q["validate_subscriptions"] = f"""with {SUBS} select id, concat_ws('; ',
        case when one_shot then 'a subscription needs a subscriber' end,
        case when st in ('P', 'F') and one_shot then 'a subscription takes a rule or labels, not both' end,
        case when dwell_ns < 0 then 'delays of a subscription must not be negative' end) as errors from subs"""
    q["flex_duration"] = """select l_orderkey, l_linenumber, l_quantity, case l_linenumber
        when 1 then l_quantity::bigint * 86400000000000
        when 2 then l_quantity::bigint * 604800000000000 + 302400000000000
        when 3 then l_quantity::bigint * 3600000000000 + 1801500000000
        when 6 then l_quantity::bigint * 1001001 end::bigint as ns from lineitem"""
    q["cfg_apply_changes"] = APPLY + """, latest as (select * from fold qualify n = max(n) over (partition by id))
        select id, name, created_at, updated_at from latest where created_at is not null"""
    q["cfg_rejected_creates"] = APPLY + " select id, version from fold where rejected"
    q["cfg_cascade"] = f"with {SUBS} select id from subs where subscriber_id in (select id from people)"
    q["rules_by_name"] = f"with {SUBS} select id, name, enabled from parts order by name, id"
    q["rules_by_input"] = f"with {SUBS} select id, name from parts where enabled"
    q["dwell_first_notify"] = f"""with {DELIVERY} done as (select 1)
        select rule_id, open_at, dwell::bigint * 1000000 as dwell_us, rep::bigint * 1000000 as repeat_us, now, seq from firsts"""
    for kind in ("firing", "repeat", "resolved"):
        q["notify_" + kind] = f"""with recursive {CHAIN}
            select rule_id, open_at, subscription_id, kind, now, seq from dispatched where kind = '{kind}'"""
    q["one_shot"] = f"""with recursive {SEND} select subscription_id, rule_id, open_at, kind, now, 3 as n_bindings
        from deliveries where one_shot"""
    q["incident_sub_states"] = f"""with recursive {CHAIN} select incident_id, subscription_id,
        max(date_trunc('millisecond', now)) filter (kind <> 'resolved') as last_notified_at,
        count(*) filter (kind <> 'resolved')::bigint as notify_count, bool_or(kind = 'resolved') as resolution_sent
        from dispatched group by all"""
    audit = "incident_id, subscription_id, subscriber_id, channel, address, kind, date_trunc('millisecond', now) as sent_at"
    q["notification_audit"] = f"""with recursive {SEND} select {audit}, case when failed then 'error' else 'ok' end as status from sent"""
    q["delivery_counters"] = f"""with recursive {SEND},
        skip(subscription_id, k) as (values ('s-direct', 1), ('s-ops', 1), ('s-prod', 2), ('s-once', 0), ('s-peak', 1), ('s-untiered', 0))
        select subscription_id, count(b.channel) filter (not failed)::bigint as sent_ok,
               count(b.channel) filter (failed)::bigint as sent_err,
               (any_value(k) * count(distinct (incident_id, kind, now)))::bigint as skipped
        from deliveries join skip using (subscription_id) join bind b using (subscription_id) group by subscription_id"""
    q["notification_payload"] = f"""with recursive {SEND} select incident_id, rule_id, rule_name, severity, description, value, kind,
        address, now, now as triggered_at, open_at as incident_triggered_at from sent"""
    q["delivery_results"] = f"""with recursive {SEND} select subscription_id, channel, kind, date_trunc('millisecond', now) as sent_at,
        case when failed or (rule_id = 'errs' and kind = 'resolved') then 'error' else 'ok' end as status from sent"""
    every = "case type " + " ".join(f"when '{t}' then ({p})::varchar" for t, p in PAYLOADS.values()) + " end"
    q["notification_plan"] = f"""with recursive {SEND} select rule_id, subscription_id, channel, kind,
        date_trunc('millisecond', now) as sent_at, value, {every} as payload from sent"""
    for name, (kind, payload) in PAYLOADS.items():
        q["payload_" + name] = f"""with recursive {SEND} select subscription_id, rule_id, kind,
            date_trunc('millisecond', now) as sent_at, ({payload})::varchar as payload from sent where type = '{kind}'"""
    q["incidents_recent"] = f"with {INCIDENT_TABLE} select * from incidents order by triggered_at desc, id limit 100"
    q["incidents_for_rule"] = f"""with {INCIDENT_TABLE} select * from incidents where rule_id = 'errs'
        order by triggered_at desc, id limit 250"""
    q["notifications_recent"] = f"""with recursive {SEND} select date_trunc('millisecond', now) as sent_at from sent
        order by now desc limit 100"""
    q["incident_drilldown"] = f"""with recursive {SEND}
        select i.incident_id as id, i.rule_id, case when i.close_at is null then 'firing' else 'resolved' end as status,
               count(s.kind)::int as n, case when count(s.kind) > 0 then 'firing' end as first_kind,
               date_trunc('millisecond', max(s.now)) as last_sent
        from inc i left join sent s using (incident_id) group by all"""
    q["subscription_notified"] = f"with recursive {SEND} select distinct subscription_id as id from sent"
    export = f"""select id, rule_id, {RFC.format('triggered_at')} as triggered_at,
        coalesce({RFC.format('resolved_at')}, '') as resolved_at, last_value from incidents"""
    q["export_incidents"] = f"with {INCIDENT_TABLE} {export}"
    q["export_since"] = f"with {INCIDENT_TABLE} {export} where rule_id = 'hi' and incidents.triggered_at >= timestamp '2024-01-24'"
    old = "timestamp '2024-01-16'"
    q["retention_candidates"] = f"with {INCIDENT_TABLE} select * from incidents where resolved_at < {old}"
    q["retention_keep_incidents"] = f"with {INCIDENT_TABLE} select * from incidents where not coalesce(resolved_at < {old}, false)"
    gone = f"gone as (select incident_id from inc where date_trunc('millisecond', close_at) < {old})"
    q["retention_keep_notifications"] = f"""with recursive {SEND}, {gone} select incident_id, subscription_id, channel, kind,
        date_trunc('millisecond', now) as sent_at from sent where incident_id not in (select incident_id from gone)"""
    states = q["incident_sub_states"].split("select incident_id, subscription_id,", 1)[1]
    q["retention_keep_sub_states"] = f"""with recursive {CHAIN}, {gone} select incident_id, subscription_id,
        {states.replace('group by all', 'where incident_id not in (select incident_id from gone) group by all')}"""
    q["retention_counts"] = f"""with recursive {SEND}, {gone}
        select 'incidents' as table_name, count(*)::bigint as deleted from gone
        union all select 'notifications', count(*)::bigint from sent where incident_id in (select incident_id from gone)
        union all select 'incident_sub_states', count(distinct (incident_id, subscription_id))::bigint from dispatched
        where incident_id in (select incident_id from gone)"""
    q["archive_entries"] = f"""with recursive {SEND}, {gone}
        select i.incident_id, date '2024-02-01' as archive_date, i.rule_id,
               strftime(date_trunc('millisecond', i.close_at), '%Y-%m-%dT%H:%M:%S.%gZ') as resolved_at, count(s.kind)::int as n
        from inc i join gone using (incident_id) left join sent s on s.incident_id = i.incident_id group by all"""
    return q
