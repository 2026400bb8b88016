"""``judge`` in DuckDB."""

from __future__ import annotations

from seqlake.llm.url_filter import DAMPING, FLOOR, RATIO, RULES, SETTLED


def judge_sql(rounds: int = 160) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    link = r"""(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    fits = " ".join(f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then '{r}'" for r in sorted(RULES, key=lambda r: -len(str(r))))
    blocked = ", ".join(f"'{r}'" for r in RULES if r.verdict == "block")
    ctes = [
        rf"r0 as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html from pages)",
        f"r1 as (select *, case {fits} end as rule from r0)",
        f"r2 as materialized (select *, case when rule in ({blocked}) then 'block' when rule is not null then 'allow' end as judged from r1)",
        f"linked as (select distinct page_id, host as src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: lower(x)))) as dst from r2 where host <> '')",
        "hosts as materialized (select host, count(*) filter (judged = 'allow') as allowed, count(*) filter (judged = 'block') as blocked from r2 where host <> '' group by host)",
        r"ties as (select host, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) as parent from hosts)",
        "links as materialized (select src, dst, count(*) as n from (select src, dst from linked union all select host, parent from ties where parent <> '' union all select parent, host from ties where parent <> '') where src <> dst group by all)",
        "nodes as materialized (select host, case when sum(allowed) > 0 and sum(blocked) = 0 then 1.0 else 0.0 end::double as trusted, case when sum(blocked) > 0 then 1.0 else 0.0 end::double as blamed from (select * from hosts union all select src, 0, 0 from links union all select dst, 0, 0 from links) group by host)",
        "edges as materialized (select 't' as kind, src as a, dst as b, n / sum(n) over (partition by src) as share from links union all select 'd', dst, src, n / sum(n) over (partition by dst) from links)",
        "seeds as materialized (select 't' as kind, host, trusted / coalesce(nullif(sum(trusted) over (), 0), 1) as start from nodes union all select 'd', host, blamed / coalesce(nullif(sum(blamed) over (), 0), 1) from nodes)",
        f"ranks as (select kind, host, start, start as rank, 0 as round from seeds union all select p.kind, p.host, p.start, {1 - DAMPING!r} * p.start + {DAMPING} * coalesce(f.flow, 0), p.round + 1 from ranks p left join (select edges.kind, b, sum(rank * share) as flow from ranks join edges on ranks.kind = edges.kind and host = a group by edges.kind, b) f on p.kind = f.kind and p.host = f.b where p.round < {rounds})",
        f"scored as materialized (select host, sum(rank) filter (kind = 't') as trust, sum(rank) filter (kind = 'd') as distrust, {FLOOR} / (select count(*) from nodes) as even from ranks where round = {rounds} group by host)",
    ]
    bad = f"distrust - even > {SETTLED} * even and distrust - {RATIO} * trust > {SETTLED} * even"
    return f"with recursive {', '.join(ctes)} select page_id, r2.host, path, rule, coalesce(judged, case when coalesce({bad}, false) then 'block' else 'allow' end) as verdict from r2 left join scored on r2.host = scored.host"
