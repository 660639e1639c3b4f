"""DuckDB SQL for the named queries, written from the semantics, not from the Spark plans."""

from __future__ import annotations

from ..functions.urls import TWO_PART_SUFFIXES
from ..operators.rules import SUBSTRING_COLORS, SUBSTRING_RULES, TITLE_WORDS, Category, built_in
from ..schema import EVENT_KINDS
from .queries import categories

NOW = "timestamp '2024-01-31 00:00:00'"

VISITS = """
visits as (
  select e.event_id, e.ts, e.user_id, e.event_type, p.page_id, p.url, regexp_extract(p.html, '<title>([^<]*)</title>', 1) as title
  from (select e0.*, n.n from events e0 cross join (select count(*) as n from pages) n) e join pages p on e.event_id % e.n = p.page_id
)"""

H = (
    VISITS
    + """, h0 as (
  select page_id as pos, url, title, count(*) as visits0, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as typed_count, max(ts) as last_visit
  from visits group by page_id, url, title
), h as (
  select pos, url, title, cast(1 + (pos * 37) % 120 as bigint) as visit_count, typed_count, last_visit,
         strftime(last_visit, '%Y-%m-%dT%H:%M:%SZ') as when_text from h0
)"""
)

#: Parts of a URL, step by step.
PARTS = """
s0 as (
  select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]{0,29}):(//)?', 0) as mark,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]{0,29}):', 1)) as scheme from pages
), s1 as (select *, substring(url, length(mark) + 1) as tail from s0),
s2 as (select *, regexp_extract(tail, '^([^/?#]*)', 1) as authority from s1),
s3 as (
  select *, regexp_extract(authority, '^([^@]*)@', 1) as userinfo,
         case when contains(authority, '@') then regexp_extract(authority, '^[^@]*@(.*)$', 1) else authority end as hostport from s2
), s4 as (
  select *, case when starts_with(hostport, '[') then regexp_extract(hostport, '^(\\[[^\\]]*\\])', 1) else regexp_extract(hostport, '^([^:]*)', 1) end as host from s3
), s5 as (select *, substring(hostport, length(host) + 1) as behind from s4),
s6 as (select *, regexp_extract(behind, '^:([0-9]{0,7})', 1) as digits from s5),
s7 as (
  select *, case when try_cast(digits as integer) between 1 and 65535 then try_cast(digits as integer) else -1 end as port,
         (case when starts_with(behind, ':') then substring(behind, length(digits) + 2) else behind end) || substring(tail, length(authority) + 1) as remaining from s6
), parts as (
  select page_id, url, scheme, userinfo, host, port, regexp_extract(remaining, '^([^?#]*)', 1) as path,
         regexp_extract(remaining, '^[^?#]*\\?([^#]*)', 1) as query, regexp_extract(remaining, '^[^#]*#(.*)$', 1) as fragment from s7
)"""

_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_PART_SUFFIXES)
DOMAINS = (
    PARTS
    + f""", d0 as (select page_id, lower(host) as full_host, string_split(lower(host), '.') as l from parts),
d1 as (select *, len(l) as n, array_to_string(l[-2:], '.') as two from d0),
domains as (
  select page_id, full_host,
         case when n <= 2 then full_host when two in ({_SUFFIXES}) and n >= 4 then array_to_string(l[-3:], '.') when two in ({_SUFFIXES}) then full_host else two end as registrable_domain,
         l[-1] as tld,
         case when n <= 2 then '' when two in ({_SUFFIXES}) and n >= 4 then array_to_string(l[:n - 3], '.') when two in ({_SUFFIXES}) then '' else array_to_string(l[:n - 2], '.') end as subdomain
  from d1
)"""
)

HOST = "lower(regexp_extract(url, '^(?:.*?://)?([^/:?#]*)', 1))"
PATH = "regexp_extract(url, '^(?:.*?://)?[^/:?#]*(?::[^/?#]*)?(/[^?#]*)', 1)"
SEARCH_HOST = "lower(regexp_extract(url, '^(?:.*?://)?([^/:]*)', 1))"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _domain_test(pattern: str, host: str = "host") -> str:
    p = pattern.lower()
    tests = [f"{host} = {_text(p)}", f"ends_with({host}, {_text('.' + p)})"]
    if p.startswith("*."):
        tests += [f"ends_with({host}, {_text(p[1:])})", f"{host} = {_text(p[2:])}"]
    if p.endswith(".*"):
        tests.append(f"(starts_with({host}, {_text(p[:-1])}) and length({host}) > {len(p) - 1})")
    return "(" + " or ".join(tests) + ")"


def _categorized(own: list[Category], globs: dict[str, str]) -> str:
    by_rule, by_word = [], []
    for i, c in enumerate(own):
        tests = [_domain_test(r.domain) if r.pattern is None else f"({_domain_test(r.domain)} and path <> '' and regexp_matches(path, {_text(globs[r.pattern])}))" for r in c.rules]
        by_rule.append(f"when {' or '.join(tests)} then {i}")
        if c.keywords:
            by_word.append("when " + " or ".join(f"contains(t, {_text(k)})" for k in c.keywords) + f" then {i}")
    names = " ".join(f"when {i} then {_text(c.name)}" for i, c in enumerate(own))
    return f"""
c0 as (select *, {HOST} as host, {PATH} as path, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from h),
c1 as (select *, case {' '.join(by_rule)} end as r, case {' '.join(by_word)} end as w from c0),
c as (
  select *, coalesce(r, w, -1) as category_idx, case coalesce(r, w, -1) {names} else 'Uncategorized' end as category,
         case when r is not null then 90 when w is not null then 50 else 0 end as confidence from c1
)"""


def _like_any(column: str, parts: list[str]) -> str:
    return " or ".join(f"contains({column}, {_text(p)})" for p in parts)


def _substring_case() -> str:
    whens = [f"when {_like_any('url', parts.split())} then {_text(name)}" for name, parts in SUBSTRING_RULES]
    whens += [f"when {_like_any('title', words.split())} then {_text(name)}" for name, words in TITLE_WORDS]
    return f"case {' '.join(whens)} else 'Other' end"


SUBSTRING = f"sc as (select *, {_substring_case()} as category from h)"
_ORDER = " ".join(f"when {_text(n)} then {i}" for i, n in enumerate(SUBSTRING_COLORS))

HOURS = """
hours as (
  select r.hour, coalesce(v.visits, 0) as visits from (select cast(unnest(range(24)) as integer) as hour) r
  left join (select cast(hour(last_visit) as integer) as hour, cast(sum(visit_count) as bigint) as visits from h group by 1) v on r.hour = v.hour
)"""
WEEKDAYS = """
days as (
  select r.weekday, coalesce(v.visits, 0) as visits from (select cast(unnest(range(7)) as integer) as weekday) r
  left join (select cast(dayofweek(last_visit) as integer) as weekday, cast(sum(visit_count) as bigint) as visits from h group by 1) v on r.weekday = v.weekday
)"""
PEAKS = """
peaks as (
  select (select hour from hours order by visits desc, hour limit 1) as peak_hour, (select hour from hours order by visits, hour limit 1) as quiet_hour,
         (select weekday from days order by visits desc, weekday limit 1) as peak_day
)"""


def _sessions(source: str, key: str | None, ts: str, tie: str, gap: int) -> str:
    part = f"partition by {key}" if key else ""
    keys = f"{key}, " if key else ""
    return f"""
g0 as (select *, {ts} - lag({ts}) over ({part} order by {ts}, {tie}) as apart from {source}),
g1 as (select *, sum(case when apart is null or apart > interval {gap} seconds then 1 else 0 end) over ({part} order by {ts}, {tie} rows unbounded preceding) as session_no from g0),
g as (
  select {keys}cast(session_no as bigint) as session_no, min({ts}) as start, max({ts}) as "end", count(*) as page_count,
         (epoch_us(max({ts})) - epoch_us(min({ts}))) // 1000000 / 60.0 as minutes, 1 as tab_count,
         case when count(*) > 3 then 'DEEP_BROWSE' else 'ACTIVE' end as state from g1 group by {keys}session_no
)"""


def _hit(term: str) -> tuple[str, str]:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"contains({low.format('url')}, {_text(term)})", f"contains({low.format('title')}, {_text(term)})"


def _score(u: str, t: str) -> str:
    return f"""least(100, (case when {u} and {t} then 40 when {t} then 30 when {u} then 20 else 0 end)
      + (case when visit_count >= 100 then 30 when visit_count >= 50 then 25 when visit_count >= 20 then 20 when visit_count >= 10 then 15 when visit_count >= 5 then 10 when visit_count > 0 then 5 else 0 end)
      + (case when age <= 1 then 30 when age <= 7 then 25 when age <= 30 then 20 when age <= 90 then 15 when age <= 365 then 10 else 5 end)) / 100.0"""


def _search(terms: list[tuple[str, str, str]], condition: str, extra: str = "true") -> str:
    """terms: for each, the URL test, the title test, and whether it is negated."""
    u = " or ".join(f"({x})" for x, _, _ in terms)
    t = " or ".join(f"({x})" for _, x, _ in terms)
    count = " + ".join(f"cast({'not ' if neg else ''}(({a}) or ({b})) as integer)" for a, b, neg in terms)
    named = {f"m{i}": f"({'not ' if neg else ''}(({a}) or ({b})))" for i, (a, b, neg) in enumerate(terms)}
    for name, test in named.items():
        condition = condition.replace(name, test)
    return f"""with {H}, a as (select *, (cast(epoch({NOW}) as bigint) - cast(floor(epoch(last_visit)) as bigint)) // 86400 as age, {SEARCH_HOST} as host from h),
f as (select *, ({u}) as url_hit, ({t}) as title_hit, {count} as match_count from a where ({extra}) and ({condition}))
select pos, url_hit, title_hit, match_count, {_score('url_hit', 'title_hit')} as score from f"""


def _tabs() -> str:
    """The tab machine: one step of recursion takes the next event of every user."""
    kinds = " ".join(f"when '{event}' then '{kind}'" for event, kind in EVENT_KINDS.items())
    gap = 1800 * 1_000_000
    return f"""with recursive {VISITS.strip()}, e as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) as i, epoch_us(ts) as us, cast(event_id % 5 + 1 as bigint) as tab_id, coalesce(url, '') <> '' as page,
         case event_type {kinds} end as kind from visits
), run as (
  select distinct user_id, cast(0 as bigint) as i, cast(0 as bigint) as session_no, cast(0 as bigint) as start_us, cast(0 as bigint) as end_us, cast(0 as bigint) as pages, cast([] as boolean[]) as tabs,
         cast(-1 as bigint) as active, cast(0 as bigint) as most, cast(0 as bigint) as switches, 'ACTIVE' as state, cast([] as varchar[]) as moves from e
  union all
  select user_id, i, session_no, start_us, end_us, pages, tabs, active, most, switches, next_state, case when next_state <> state then list_append(moves, state || '>' || next_state) else moves end
  from (
    select *, case when full_up then state when us - end_us > {gap} then 'IDLE' when state = 'IDLE' and kind in ('OPEN', 'NAVIGATE') then 'ACTIVE'
                   when state = 'ACTIVE' and switches = 0 and pages > 3 then 'DEEP_BROWSE' when state = 'ACTIVE' and switches > 5 and us - end_us < 60000000 then 'RAPID_FIRE'
                   when state = 'DEEP_BROWSE' and kind = 'SWITCH' then 'ACTIVE' when state = 'RAPID_FIRE' and us - end_us > 30000000 then 'ACTIVE' else state end as next_state
    from (
      select user_id, i, us, kind, full_up, session_no, start_us, state, moves, tabs2 as tabs,
             case when full_up then end_us else greatest(end_us, us) end as end_us,
             pages + cast(page and not full_up and kind in ('OPEN', 'NAVIGATE') or kind = 'RELOAD' and live > 0 as int) as pages,
             case when adds and not full_up then len(tabs2) when kind = 'CLOSE' and known and active = tab_id then coalesce(list_max(list_filter(range(1, len(tabs2) + 1), lambda k: tabs2[k])), -1)
                  when kind = 'SWITCH' and known and tabs[tab_id] then tab_id else active end as active,
             case when adds and not full_up then greatest(most, len(list_filter(tabs2, lambda o: o))) else most end as most,
             switches + cast(kind = 'SWITCH' and known and tabs[tab_id] as int) as switches
      from (
        select *, adds and len(tabs) >= 64 as full_up, tab_id <= len(tabs) as known,
               case when adds and len(tabs) < 64 then list_append(tabs, true) when kind = 'CLOSE' and tab_id <= len(tabs) then list_transform(tabs, lambda o, k: o and k <> tab_id) else tabs end as tabs2
        from (
          select *, kind = 'OPEN' or (kind = 'NAVIGATE' and live = 0) as adds
          from (
            select *, case when active > 0 and tabs[active] then active else 0 end as live
            from (
              select e.user_id, e.i, e.us, e.tab_id, e.page, e.kind, case when fresh then session_no + 1 else session_no end as session_no, case when fresh then e.us else start_us end as start_us,
                     case when fresh then e.us else end_us end as end_us, case when fresh then 0 else pages end as pages, case when fresh then cast([] as boolean[]) else tabs end as tabs,
                     case when fresh then -1 else active end as active, case when fresh then 0 else most end as most, case when fresh then 0 else switches end as switches,
                     case when fresh then 'ACTIVE' else state end as state, case when fresh then cast([] as varchar[]) else moves end as moves
              from (select r.*, r.session_no = 0 or n.us - r.end_us > {gap} as fresh from run r join e n on n.user_id = r.user_id and n.i = r.i + 1) r join e on e.user_id = r.user_id and e.i = r.i + 1
            )
          )
        )
      )
    )
  )
), s as (select * from run where session_no > 0 qualify row_number() over (partition by user_id, session_no order by i desc) = 1),
moved as (
  select user_id, session_no, string_agg('"' || m || '":' || n, ',' order by place) as moves
  from (select user_id, session_no, m, count(*) as n, min(place) as place from (select user_id, session_no, unnest(moves) as m, generate_subscripts(moves, 1) as place from s) group by 1, 2, 3) group by 1, 2
)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["history_view"] = f"with {H} select pos, url, title, visits0 as visit_count, typed_count, last_visit from h0"
    out["url_parts"] = f"with {PARTS} select page_id, scheme, userinfo, host, port, path, query, fragment from parts"
    out["registrable_domain"] = f"with {DOMAINS} select page_id, full_host, registrable_domain, tld, subdomain from domains"
    out["hosts"] = f"""select page_id, regexp_extract(url, '^.*?://([^/]*)', 1) as authority, {SEARCH_HOST} as search_host, {HOST} as rules_host, {PATH} as rules_path from pages"""
    out["host_kind"] = f"""with m as (select page_id, case when page_id % 3 = 0 then page_id % 300 || '.' || page_id * 7 % 300 || '.' || page_id * 11 % 300 || '.' || page_id * 13 % 300
      when page_id % 3 = 1 then '[::' || upper(to_hex(page_id)) || ']' else {HOST} end as host from pages)
      select page_id, host, regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') and len(list_filter(string_split(host, '.'), lambda x: try_cast(x as integer) > 255)) = 0 as is_ipv4,
      regexp_matches(host, '^\\[[0-9a-fA-F:.]*\\]') as is_ipv6 from m"""
    out["url_normalize"] = f"""with {PARTS} select page_id, scheme || '://' || lower(host) || (case when scheme = 'http' then ':443' else '' end)
      || (case when path in ('', '/') then '/' else regexp_replace(path, '/$', '') end)
      || (case when query <> '' then '?' || query else '' end) || (case when fragment <> '' then '#' || fragment else '' end) as normalized from parts"""
    out["url_round_trip"] = "select page_id, url from pages"
    out["query_params"] = f"""with {PARTS}, l as (select page_id, list_filter(string_split(query, '&'), lambda x: x <> '') as xs from parts),
      u as (select page_id, unnest(range(len(xs))) as pos, unnest(xs) as x from l)
      select page_id, cast(pos as bigint) as pos, regexp_extract(x, '^([^=]*)', 1) as key, regexp_extract(x, '^[^=]*=(.*)$', 1) as value from u"""
    out["percent_codes"] = f"""with {H} select pos, cast(length(regexp_replace(url_encode(title), '%20', '%20', 'g')) as bigint) as coded_length, title as decoded from h"""
    out["utf8_valid"] = f"with {H} select pos, true as valid, false as valid_cut from h"
    out["epoch_normalize"] = """with e as (select event_id, epoch_us(ts) as us from events) select event_id,
      case event_id % 4 when 0 then us + 11644473600000000 when 1 then us when 2 then us // 1000 else us // 1000000 end as raw,
      case event_id % 4 when 0 then 'chromium' when 1 then 'firefox' when 2 then 'unix_ms' else 'unix' end as ts_format, us // 1000000 as unix_seconds from e"""
    out["iso_time"] = "select event_id, case when event_id % 10 = 0 then '(never)' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as iso from events"
    out["display_text"] = f"""with {H} select pos, case when length(url) > 30 then substring(url, 1, 27) || '...' else url end as short_url,
      replace(replace(replace(replace(replace(case when title = '' then '(untitled)' else title end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped,
      '[' || typed_count || '] ' || case when title = '' then '(untitled)' else title end as decorated from h"""
    out["relative_times"] = f"""with a as (select event_id, event_id * 420 as s, {NOW} - to_seconds(event_id * 420) as seen from events)
      select event_id, case when s < 60 then 'just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago'
      when year(seen) = 2024 then strftime(seen, '%b ') || day(seen) || strftime(seen, ' %H:%M') else strftime(seen, '%Y-%m-%d') end as shown from a"""
    out["page_metadata"] = """select page_id, '' as description, '' as keywords, '' as og_title, '' as og_image, '' as og_type, '' as canonical,
      regexp_extract(html, '<html lang="([^"]*)"', 1) as lang from pages"""
    out["history_stats"] = f"""with {H} select count(*) as total_urls, cast(sum(visit_count) as bigint) as total_visits, min(last_visit) as earliest, max(last_visit) as latest,
      (select url from h order by visit_count desc, pos limit 1) as top_url, (select title from h order by visit_count desc, pos limit 1) as top_title, max(visit_count) as top_visits,
      count(distinct regexp_extract(url, '^.*?://([^/]*)', 1)) as unique_authorities from h"""
    out["unique_authorities"] = f"with {H} select count(distinct regexp_extract(url, '^.*?://([^/]*)', 1)) as unique_authorities from h where contains(url, '://')"
    out["unique_hosts"] = f"with {H} select count(distinct {HOST}) as unique_hosts from h"
    out["hourly_visits"] = f"with {H}, {HOURS} select hour, visits from hours"
    out["weekday_visits"] = f"with {H}, {WEEKDAYS} select weekday, visits from days"
    out["peak_hours"] = f"with {H}, {HOURS}, {WEEKDAYS}, {PEAKS} select * from peaks"
    out["bar_scaling"] = f"with {H}, {HOURS} select hour, visits, visits * 100 // greatest((select max(visits) from hours), 1) as bar from hours"
    out["browsing_analysis"] = f"""with {H}, {SUBSTRING}, {HOURS}, {WEEKDAYS}, {PEAKS},
      v as (select count(*) as entries, cast(coalesce(sum(visit_count) filter (where category in ('Development', 'Productivity', 'Education', 'AI Tools')), 0) as bigint) as productive,
        cast(coalesce(sum(visit_count) filter (where category in ('Social Media', 'Entertainment')), 0) as bigint) as distracting,
        count(*) filter (where category = 'AI Tools') as ai_entries, cast(coalesce(sum(visit_count) filter (where category = 'AI Tools'), 0) as bigint) as ai_visits from sc),
      d as (select category as dominant_category, cast(sum(visit_count) as bigint) as dominant_visits from sc group by category order by 2 desc, case category {_ORDER} end limit 1),
      r as (select *, 100 * productive // (productive + distracting + 1) as productivity_score, dominant_visits * 100 // (entries + 1) as dominant_percent from v, d, peaks)
      select entries, productive, distracting, productivity_score, dominant_category, dominant_visits, dominant_percent, peak_hour, quiet_hour, peak_day,
        'Your browsing is dominated by ' || dominant_category || ' (' || dominant_percent || '% of tracked visits).' as insight_primary,
        'Peak activity at ' || peak_hour || ':00 on ' || ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][peak_day + 1] || 's. Quietest hour: ' || quiet_hour || ':00.' as insight_focus,
        'Productivity score: ' || productivity_score || '/100 — ' || case when productivity_score >= 70 then 'Highly focused browsing pattern.' when productivity_score >= 40 then 'Balanced between work and leisure.' else 'Leisure-heavy browsing detected.' end as insight_habit,
        case when ai_entries > 0 then 'AI tool usage detected (' || ai_visits || ' visits). You''re leveraging AI effectively.' else 'Consider using AI tools like ChatGPT or Claude to boost productivity.' end as insight_recommendation from r"""
    out["capture_counters"] = "select count(*) as total, count(*) filter (where event_type = 'error') as incognito, count(*) filter (where event_type <> 'error') as normal from events"
    out["dedup_merge"] = f"""with {H} select url, pos, title, case when pos % 2 = 0 then greatest(visit_count, visit_count * 7 % 100) else visit_count end as visit_count, typed_count, last_visit from h"""
    out["bag_union"] = f"""with {H}, x as (select pos, url, title, visit_count, typed_count, last_visit from h)
      select * from x union all select * from x where visit_count > 60 union all select * from x where pos < 10"""
    out["days_back_gt"] = f"with {VISITS} select event_id, ts, url from visits where ts > {NOW} - interval 7 days"
    out["days_back_ge"] = f"with {VISITS} select event_id, ts, url from visits where ts >= {NOW} - interval 7 days"
    out["consecutive_dedup"] = """with b as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
      select user_id, ts, event_id, event_type from b where before is null or before <> event_type"""
    out["last_n"] = f"with {VISITS} select event_id, ts, url from visits order by ts desc, event_id limit 1000"
    out["last_n_per_user"] = "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id) as r from events) where r <= 5"
    out["scan_order"] = f"with {H} select pos, row_number() over (order by last_visit desc, pos) as rank from h"
    out["capture_filter"] = "select page_id, url from pages where page_id % 5 <> 0 and page_id % 7 <> 0"
    out["http_only"] = "select page_id, url from pages where starts_with(url, 'http')"
    out["csv_row_filter"] = """with m as (select page_id, case when page_id % 4 = 0 then substring(url, 9) when page_id % 9 = 0 then 'about:home' else url end as url from pages)
      select page_id, url from m where url <> '' and (contains(url, '://') or starts_with(url, 'about:') or starts_with(url, 'file:') or starts_with(url, 'data:'))"""
    out["history_query"] = f"with {VISITS} select event_id, ts, url, title from visits where event_type <> 'error' and ts >= {NOW} - interval 10 days order by ts desc, event_id limit 500"
    u, t = _hit("th")
    u2, _ = _hit("docs")
    out["popup_search"] = f"with {H} select pos, url, title from h where {t} or {u2}"
    out["metadata_asof"] = """with v as (select event_id, user_id, ts from events where event_type = 'click'), m as (select event_id as m_id, user_id, ts as m_ts from events where event_type = 'view'),
      pairs as (select v.event_id, m.m_id, m.m_ts, row_number() over (partition by m.m_id order by v.ts desc, v.event_id desc) as r, v.ts from m join v on v.user_id = m.user_id and v.ts <= m.m_ts),
      near as (select event_id, m_id, row_number() over (partition by event_id order by m_ts desc, m_id desc) as k from pairs where r = 1 and m_ts <= ts + interval 1 hour)
      select v.event_id, v.user_id as tab_id, v.ts, 'd' || n.m_id as description from v left join near n on n.event_id = v.event_id and n.k = 1"""
    own = _categorized(categories(), {"/*/[a-m]*": "^/.*/[a-m].*$"})
    out["categorize"] = f"with {H}, {own} select pos, category_idx, category, confidence from c"
    out["categorize_builtin"] = f"with {H}, {_categorized(built_in(), {})} select pos, category_idx, category, confidence from c"
    every = " union all ".join(f"select {i} as category_idx, {_text(n)} as category" for i, n in [*enumerate(c.name for c in categories()), (-1, "Uncategorized")])
    out["category_stats"] = f"""with {H}, {own}, every as ({every}) select e.category_idx, e.category, count(c.pos) as url_count, cast(coalesce(sum(c.visit_count), 0) as bigint) as total_visits,
      coalesce(first(c.host order by c.visit_count desc, c.pos) filter (where c.pos is not null), '') as top_domain from every e left join c on c.category_idx = e.category_idx group by 1, 2"""
    out["substring_categories"] = f"with {H}, {SUBSTRING} select pos, category, case category {_ORDER} end as category_idx from sc"
    out["substring_category_stats"] = f"""with {H}, {SUBSTRING} select category, count(*) as url_count, cast(sum(visit_count) as bigint) as total_visits,
      first(url order by visit_count desc, pos) as top_url, first(title order by visit_count desc, pos) as top_title from sc group by category"""
    out["glob_paths"] = f"""with p as (select page_id, {PATH} as path from pages) select page_id, path, regexp_matches(path, '^/.*[0-9].*$') as digits,
      regexp_matches(path, '^/.[^a-m].*$') as second, regexp_matches(path, '^/[a-m].*/.*$') as deep from p"""
    out["domain_patterns"] = f"""with p as (select page_id, {HOST} as host from pages) select page_id, {_domain_test('example.com')} as exact, {_domain_test('*.example.net')} as below, {_domain_test('www.*')} as prefix from p"""
    rows = [(i, c.name, r.kind) for i, c in enumerate(built_in()) for r in c.rules]
    values = " union all ".join(f"select {i} as cat_idx, {_text(n)} as cat_name, '{k}' as type, cast({rows.count((i, n, k))} as bigint) as n" for i, n, k in dict.fromkeys(rows))
    out["rules_table"] = values
    top = f"with {H}, {DOMAINS}, x as (select h.*, d.registrable_domain, d.full_host from h join domains d on d.page_id = h.pos)"
    out["domain_topk"] = f"{top} select registrable_domain as domain, count(*) as url_count, cast(sum(visit_count) as bigint) as visit_count from x group by 1 order by 3 desc, min(pos) limit 15"
    out["host_topk"] = f"{top} select full_host as domain, count(*) as url_count, cast(sum(visit_count) as bigint) as visit_count, min(pos) as first_pos from x group by 1 order by 3 desc, 4 limit 32"
    out["domain_rollup"] = f"""{top}, l as (select string_split(full_host, '.') as l, visit_count from x), e as (select l, visit_count, unnest(range(1, len(l) + 1)) as k from l)
      select array_to_string(l[len(l) - k + 1:], '.') as suffix, count(*) as url_count, cast(sum(visit_count) as bigint) as visit_count from e group by 1"""
    out["domain_lookup"] = f"{top} select full_host as domain, count(*) as url_count, cast(sum(visit_count) as bigint) as visit_count from x where full_host in ('therha.example.com', 'therin.example.net', 'nowhere.test') group by 1"
    out["domain_aggregate"] = f"""{top} select d.domain, case when count(x.pos) > 0 then count(x.pos) else -1 end as url_count, cast(coalesce(sum(visit_count), -1) as bigint) as visit_count
      from (select unnest(['com', 'example.org', 'nowhere.test']) as domain) d left join x on x.full_host = d.domain or ends_with(x.full_host, '.' || d.domain) group by 1"""
    out["unique_domains"] = f"{top} select count(distinct registrable_domain) as unique_domains from x"
    th, docs, net, on = ((*_hit(w), False) for w in ("th", "docs", "net", "on"))
    out["search_substring"] = _search([th], "m0")
    out["search_boolean"] = _search([th, docs, net, (on[0], on[1], True)], "((m0 and m1) or m2) and m3")
    out["search_domain"] = _search([("host = 'example.com' or (ends_with(host, '.example.com') and length(host) > 12)", "false", False)], "m0")
    of = (*_hit("of"), True)
    out["search_tld"] = _search([("contains(host, '.') and regexp_extract(host, '([^.]*)$', 1) = 'org'", "false", False), of], "m0 and m1")
    regex = "'(?i)^https?://[a-z]+[a-zA-Z0-9.]*\\.(com|net)/'"
    out["search_regex"] = _search([(f"regexp_matches(url, {regex})", f"regexp_matches(title, {regex})", False)], "m0")
    out["search_dates"] = _search([(*_hit("e"), False)], "m0", "when_text >= '2024-01-29' and when_text <= '2024-01-30T12' and visit_count >= 40")
    out["search_quoted"] = _search([(*_hit("of the"), False), (*_hit("in th"), False)], "m0 or m1")
    ranked = _search([th, docs], "m0 or m1").replace("select pos, url_hit", "select pos as pos, url_hit")
    out["search_ranked"] = f"select pos, score, row_number() over (order by score desc, pos) as rank from (select * from ({ranked}) order by pos limit 100)"
    out["sessions_30m"] = f"with {_sessions('events', 'user_id', 'ts', 'event_id', 1800)} select * from g"
    out["sessions_12h"] = f"with {_sessions('events', 'user_id', 'ts', 'event_id', 43200)} select * from g"
    out["history_sessions"] = f"with {H}, {_sessions('h', None, 'last_visit', 'pos', 1800)} select * from g"
    out["session_window_builtin"] = f'with {_sessions("events", "user_id", "ts", "event_id", 1800)} select user_id, start, "end", page_count from g'
    out["session_stats"] = f"""with {_sessions('events', 'user_id', 'ts', 'event_id', 43200)} select count(*) as total_sessions, cast(sum(page_count) as bigint) as total_pages, avg(minutes) as avg_minutes,
      avg(tab_count) as avg_tabs, max(minutes) as longest_minutes, first(user_id order by minutes desc, user_id, session_no) as longest_user_id, first(session_no order by minutes desc, user_id, session_no) as longest_session_no,
      first(user_id order by user_id, session_no) as most_tabs_user_id, first(session_no order by user_id, session_no) as most_tabs_session_no from g"""
    out["tab_state_machine"] = f"""{_tabs()} select s.user_id, s.session_no, start_us, end_us, pages as page_count, len(tabs) as tab_count, most as max_concurrent_tabs, switches as tab_switches,
      ((end_us - start_us) // 1000000) / 60 as minutes, state, '{{' || coalesce(m.moves, '') || '}}' as transitions from s left join moved m on m.user_id = s.user_id and m.session_no = s.session_no"""
    out["stream_tab_machine"] = f"{_tabs()} select user_id, session_no, start_us, end_us, pages as page_count, state from s"
    out["csv_import"] = f"with {H} select url, rtrim(title) as title, visit_count, typed_count, when_text as last_visit_time, date_trunc('second', last_visit) as last_visit from h"
    out["bookmark_import"] = f"with {H} select url, trim(title) as title, 1 as visit_count, when_text as last_visit_time from h"
    out["json_export"] = f"with {H} select url, title, visit_count, typed_count, when_text as last_visit_time from h"
    out["chromium_import"] = f"with {H} select url, title, visit_count, typed_count, when_text as last_visit_time from h where last_visit > {NOW} - interval 7 days"
    out["firefox_import"] = f"""with {H} select h.url, h.title, h.visit_count, h.typed_count, strftime(max(v.ts), '%Y-%m-%dT%H:%M:%SZ') as last_visit_time
from visits v join h on h.pos = v.page_id where v.ts >= {NOW} - interval 10 days group by h.pos, h.url, h.title, h.visit_count, h.typed_count"""
    out["json_import"] = f"with {H} select url, title, visit_count, typed_count, when_text as last_visit_time from h"
    out["stream_capture"] = "select event_id, 'https://a.com/' || event_type as url, user_id % 2 = 0 as incognito from events where event_type not in ('view', 'error')"
    return out
