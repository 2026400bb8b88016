"""URL filters with link-graph propagation, with DataFrame functions only.

Rules decide what they fit. For all other urls the host decides: trust flows from hosts with allowed urls along links
(personalised PageRank), distrust from hosts with blocked urls against them, and a host with clearly more distrust than trust
is blocked. Links are the pages' absolute hyperlinks; a host is also tied to its parent domain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import cut, drop


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The production rules (fixed values).
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Rounds that are planned together, and hosts and links up to which a graph stands in one row and all rounds are one expression.
TOGETHER, SMALL, DAMPING = 4, 50_000, 0.85
#: A host is blocked if its distrust is above FLOOR times an even share and above RATIO times its trust. Ranks are settled to
#: SETTLED of that floor, and what is nearer to a threshold than that is not above it.
FLOOR, RATIO, SETTLED = 0.1, 1.0, 0.1
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, ``host/path``; ties go to the earlier rule."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):
        found = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), str(r)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[Rule, ...]) -> Column:
    blocked = [str(r) for r in rules if r.verdict == "block"]
    return F.when(rule.isin(blocked), "block").when(rule.isNotNull(), "allow")


def propagate(nodes: DataFrame, links: DataFrame, small: int = SMALL) -> DataFrame:
    """``host, trust, distrust`` of ``nodes`` (host, trusted, blamed) over ``links`` (src, dst, n).

    Trust is the personalised PageRank from trusted hosts along links; distrust the one from blamed hosts against them. Both
    walk in one table until no host's rank can still move by more than ``SETTLED`` of the floor: each round leaves at most the
    damping's share of the last one's change. A graph of up to ``small`` hosts and links is worked on as one row of arrays,
    which spares it a job for every few rounds; the rounds are the same.
    """
    count, size = nodes.count(), links.count()
    settled = SETTLED * FLOOR / max(count, 1) * (1 - DAMPING) / DAMPING  # a change of a round after which the rest is that small
    both = F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")
    edges = links.select("n", both).select("e.*", "n")
    out = edges.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    edges = cut(edges.join(out, ["kind", "a"]).select(F.col("kind").alias("walk"), F.col("a").alias("from"), F.col("b").alias("to"), (F.col("n") / F.col("all")).alias("share")), "edges")
    trusted, blamed = nodes.agg(F.coalesce(F.sum("trusted"), F.lit(0.0)), F.coalesce(F.sum("blamed"), F.lit(0.0))).first()
    seeds = F.explode(F.array(F.struct(F.lit("t").alias("kind"), (F.col("trusted") / F.lit(trusted or 1.0)).alias("start")), F.struct(F.lit("d").alias("kind"), (F.col("blamed") / F.lit(blamed or 1.0)).alias("start")))).alias("s")
    starts = nodes.select("host", seeds).select("s.kind", "host", "s.start")
    if max(count, size) <= small:
        ranks = _in_arrays(nodes, starts, edges, math.ceil(math.log(settled / 2) / math.log(DAMPING)))
    else:
        ranks = _in_rounds(starts, edges, settled)
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return ranks.groupBy("host").agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def _in_rounds(starts: DataFrame, edges: DataFrame, settled: float) -> DataFrame:
    """``kind, host, rank``: rounds of joins and sums by host."""
    ranks = cut(starts.select("kind", "host", "start", F.col("start").alias("rank"), F.lit(0.0).alias("moved")), "ranks")
    while True:
        before, now = ranks, ranks
        for _ in range(TOGETHER):
            flow = now.join(edges, F.expr("kind = walk and host = from")).groupBy("walk", "to").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
            new = (1 - DAMPING) * F.col("start") + DAMPING * F.coalesce("flow", F.lit(0.0))
            now = now.join(flow, F.expr("kind = walk and host = to"), "left").select("kind", "host", "start", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        ranks = cut(now, "ranks")
        drop(before)
        if (ranks.agg(F.max("moved")).first()[0] or 0.0) <= settled:
            return ranks


def _in_arrays(nodes: DataFrame, starts: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """``kind, host, rank`` of a small graph: a walk is one row, its hosts numbered, and a round one transformation of its ranks."""
    numbered = nodes.select("host", (F.row_number().over(Window.orderBy("host")) - 1).alias("i"))  # as few as checked
    ends = edges.join(numbered.withColumnsRenamed({"host": "from", "i": "f"}), "from").join(numbered.withColumnsRenamed({"host": "to", "i": "t"}), "to")
    into = ends.groupBy(F.col("walk").alias("kind"), F.col("t").alias("i")).agg(F.array_sort(F.collect_list(F.struct("f", "share"))).alias("ins"))
    none = F.array().cast("array<struct<f:int,share:double>>")
    hosts = starts.join(numbered, "host").join(into, ["kind", "i"], "left").select("kind", "i", "host", "start", F.coalesce("ins", none).alias("ins"))
    walks = hosts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("i", "start", "ins", "host"))).alias("all"))
    step = f"transform(all, x -> {1 - DAMPING!r}D * x.start + {DAMPING!r}D * aggregate(x.ins, 0D, (sum, e) -> sum + r[e.f] * e.share))"
    ranked = walks.withColumn("ranks", F.expr(f"aggregate(sequence(1, {rounds}), transform(all, x -> x.start), (r, k) -> {step})"))
    return ranked.select("kind", F.explode(F.arrays_zip(F.col("all.host").alias("host"), F.col("ranks").alias("rank"))).alias("one")).select("kind", "one.host", "one.rank")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url: str = "url", html: str = "html", small: int = SMALL) -> DataFrame:
    """``id_col, host, path, rule, verdict, trust, distrust`` for each row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, and are allowed. Null html has no
    links. Repeated rows repeat and their links count again; an empty table gives none; further columns are not read.
    """
    rows = pages.select(F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = verdict_of(F.col("rule"), rules)
    linked = rows.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)), F.lower)).alias("dst"))
    hosts = cut(rows.where("host <> ''").groupBy("host").agg(F.sum(F.when(judged == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.sum(F.when(judged == "block", 1.0).otherwise(0.0)).alias("blocked")), "hosts")
    parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    ties = hosts.select("host", parent.alias("parent")).where("parent <> ''")
    both = ties.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(ties.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    links = cut(linked.union(both).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    nodes = hosts.union(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0), F.lit(0.0))).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    # A seed counts once, however many pages it has.
    nodes = cut(nodes.select("host", F.when((F.col("allowed") > 0) & (F.col("blocked") == 0), 1.0).otherwise(0.0).alias("trusted"), F.when(F.col("blocked") > 0, 1.0).otherwise(0.0).alias("blamed")), "nodes")
    even = FLOOR / max(nodes.count(), 1)
    above = lambda x, y: F.col(x) - y > F.lit(SETTLED * even)
    scored = cut(propagate(nodes, links, small).withColumn("bad", above("distrust", F.lit(even)) & above("distrust", RATIO * F.col("trust"))), "scored")
    # A third of all pages may have one host: hosts are few for each task, so AQE may broadcast them or split the hot one.
    out = rows.drop("html").join(scored, "host", "left")
    verdict = F.coalesce(judged, F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
