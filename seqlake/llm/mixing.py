"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed to cells (source, language, topic). The cells' token weights are raked, margin after margin, until they
meet the targets; a document is then kept with its cell's calibrated probability.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import cut, drop

MARGINS = ("source", "lang", "topic")
#: Rounds over all margins at most, rounds that are planned together, and the relative miss that ends them.
ROUNDS, TOGETHER, MISS = 240, 8, 1e-10
#: Cells up to which their table is raked in one task and broadcast; beyond it margins are shuffled and cells dealt with salted keys.
SMALL, SALTS = 100_000, 16
#: A text's topic is the first of which it holds a mark; ``OTHER`` if there is none.
TOPICS: Mapping[str, tuple[str, ...]] = {
    "licences": ("License", "license", "Copyright", "copyright"),
    "contacts": ("@", "555-", "+1 ("),
    "credentials": ("token", "password", "secret", "BEGIN "),
    "decorated": ("***", "###", "%%%", "$$$", "&&&"),
    "tables": (" | ",),
}
OTHER = "prose"
#: Production targets: shares of all tokens, by margin. What a margin doesn't name shares the rest.
TARGETS: Mapping[str, Mapping[str | None, float]] = {"lang": {"en": 0.5, "de": 0.15, "es": 0.15, "fr": 0.15}}


def tokens_of(text: Column) -> Column:
    """A text's weight in tokens, estimated: its bytes over four, at least one."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long"), F.lit(1).cast("long"))


def topic_of(text: Column, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> Column:
    """The first topic of which the text holds a mark; null counts as empty."""
    text, out = F.coalesce(text, F.lit("")), F.lit(OTHER)
    for name, marks in reversed(topics.items()):
        out = F.when(functools.reduce(lambda a, b: a | b, [text.contains(m) for m in marks]), name).otherwise(out)
    return out


def uniform(key: Column, seed: str) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def goals(cells: DataFrame, margin: str, exponent: float, targets: Mapping[str | None, float]) -> DataFrame:
    """``value, goal``: the share of all tokens that each value of the margin is to have."""
    shares = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("free"))
    named = F.lit(None).cast("double")
    for value, share in targets.items():
        named = F.when(F.col(margin).eqNullSafe(F.lit(value)), float(share)).otherwise(named)
    shares = shares.withColumn("named", named)
    held, free = shares.agg(F.coalesce(F.sum("named"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("free"))), F.lit(0.0))).first()
    rest = max(1.0 - held, 0.0) if free else 0.0
    goal = F.coalesce(F.col("named"), F.col("free") * F.lit(rest / (free or 1.0))) / F.lit(held + rest or 1.0)
    return shares.select(F.col(margin).alias("value"), goal.alias("goal"))


def rake(cells: DataFrame, margins: tuple[str, ...], exponent: float, targets: Mapping[str, Mapping[str | None, float]] | None = None) -> tuple[DataFrame, float]:
    """``cells`` (margins, ``tokens``) with ``weight``, shares that meet every margin's target, and the largest relative miss of a target.

    ``targets`` names shares of a margin's values; the others share the rest by their tokens to the power ``exponent``: 1
    keeps the corpus's mixture, 0 weighs all values alike. Named values that no cell has are left out, and the rest is
    scaled up. Null is a value of its own. Rounds go on until every target is met; targets that contradict one another
    (cells may be missing) can't all be met: then the last margin is, the miss says by how much the others aren't, and a
    warning tells it.
    """
    small = cells.count() <= SMALL
    tidy = lambda df: df.coalesce(1) if small else df  # noqa: E731  in one task no margin is shuffled
    cells = tidy(cells)
    for m in margins:
        target = goals(cells, m, exponent, (targets or {}).get(m, {})).withColumnsRenamed({"value": "value", "goal": f"goal_{m}"})
        cells = cells.join(F.broadcast(target) if small else target, cells[m].eqNullSafe(target["value"])).drop("value")
    total = cells.agg(F.sum("tokens")).first()[0]
    cells = cut(cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1))), "cells")
    worst, rounds = 0.0, 0
    while rounds < ROUNDS:
        before, now = cells, tidy(cells)
        for _ in range(TOGETHER):
            for m in margins:
                now = now.withColumn("weight", F.col("weight") * F.col(f"goal_{m}") / F.sum("weight").over(Window.partitionBy(m)))
        cells = cut(now, "cells")
        drop(before)
        rounds, was = rounds + TOGETHER, worst
        misses = [tidy(cells).groupBy(m).agg(F.abs(F.sum("weight") / F.first(f"goal_{m}") - 1).alias("miss")) for m in margins]
        worst = functools.reduce(DataFrame.union, [x.select("miss") for x in misses]).agg(F.coalesce(F.max("miss"), F.lit(0.0))).first()[0]
        if worst <= MISS or rounds > TOGETHER and abs(worst - was) <= 1e-6 * worst:
            break
    if worst > MISS:
        warnings.warn(f"targets are missed by up to {worst:.3g} of themselves after {rounds} rounds", stacklevel=2)
    return cells, worst


def calibrate(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with ``keep_prob``: ``min(1, c weight / tokens)``, with ``c`` such that the share ``keep`` of tokens is expected."""
    ratio = F.col("weight") / F.col("tokens")
    budget = keep * float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    c = budget
    for _ in range(60):
        full = ratio * F.lit(c) >= 1
        taken, open_ = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        better = (budget - float(taken)) / open_ if open_ and budget > taken else c
        if better <= c * (1 + 1e-12):
            break
        c = better
    return cells.withColumn("keep_prob", F.least(F.lit(1.0), ratio * F.lit(c)))


def mix(
    docs: DataFrame, *, exponent: float = 0.7, targets: Mapping[str, Mapping[str | None, float]] | None = TARGETS, topics: Mapping[str, tuple[str, ...]] = TOPICS, keep: float = 0.8, seed: str = "mix",
    id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tokens: Column | None = None, topic: Column | None = None,
) -> DataFrame:
    """The sampled rows of ``docs`` with ``mix_topic, mix_tokens, mix_weight, mix_prob, mix_miss``.

    ``targets`` are shares of all tokens by margin (``source``, ``lang``, ``topic``) and value, see ``rake``; a row stays with
    its cell's calibrated probability, such that the share ``keep`` of all tokens is expected. ``tokens`` and ``topic`` are
    columns of whoever has better ones than the estimates from the text. ``mix_miss`` says by how much a target is missed.
    Null sources and languages are values of their own; null and empty texts weigh one token. Whether a row stays hangs on
    its id and ``seed`` alone: rows that share an id stay or go together where their cells agree. An empty table gives none.
    Columns of ``docs`` with the result's names are refused.
    """
    clash = {"mix_topic", "mix_tokens", "mix_weight", "mix_prob", "mix_miss", "mix_salt"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    rows = docs.withColumns({"mix_topic": topic if topic is not None else topic_of(F.col(text), topics), "mix_tokens": tokens if tokens is not None else tokens_of(F.col(text))})
    cells = cut(rows.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    raked, miss = rake(cells, MARGINS, exponent, targets)
    cells = cut(calibrate(raked, keep).select("source", "lang", "topic", "weight", "keep_prob"), "mix")
    cells = cells.withColumnsRenamed({c: f"cell_{c}" for c in cells.columns})
    on = rows[source].eqNullSafe(cells["cell_source"]) & rows[lang].eqNullSafe(cells["cell_lang"]) & rows["mix_topic"].eqNullSafe(cells["cell_topic"])
    if cells.count() <= SMALL:
        joined = rows.join(F.broadcast(cells), on)
    else:
        salted = rows.withColumn("mix_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        each = cells.withColumn("cell_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = salted.join(each, (salted[source].eqNullSafe(each["cell_source"])) & (salted[lang].eqNullSafe(each["cell_lang"])) & salted["mix_topic"].eqNullSafe(each["cell_topic"]) & (salted["mix_salt"] == each["cell_salt"]))
    kept = joined.where(uniform(F.col(id_col), seed) < F.col("cell_keep_prob"))
    return kept.select(*docs.columns, "mix_topic", "mix_tokens", F.col("cell_weight").alias("mix_weight"), F.col("cell_keep_prob").alias("mix_prob"), F.lit(float(miss)).alias("mix_miss"))


def mix_sql(rows: str, columns: str, exponent: float = 0.7, keep: float = 0.8, seed: str = "mix", rounds: int = 120) -> str:
    """The same in DuckDB over the rows of the query ``rows``: margins raked in a recursive table."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    topic = " ".join(f"when {' or '.join(f'contains(x, {quoted(m)})' for m in marks)} then {quoted(name)}" for name, marks in TOPICS.items())
    ctes = [
        f"docs0 as (select *, coalesce(text, '') as x from ({rows}))",
        f"docs1 as materialized (select * exclude (x), case {topic} else '{OTHER}' end as topic, greatest(cast(ceil(strlen(x) / 4.0) as bigint), 1) as tokens from docs0)",
        "cells as materialized (select coalesce(source, chr(1)) as source, coalesce(lang, chr(1)) as lang, topic, cast(sum(tokens) as double) as tokens from docs1 group by all)",
    ]
    for m in MARGINS:
        named = " ".join(f"when {quoted(chr(1) if v is None else v)} then {share!r}" for v, share in TARGETS.get(m, {}).items())
        ctes.append(f"free_{m} as (select {m}, pow(sum(tokens), {exponent}) as free, {f'case {m} {named} end' if named else 'cast(null as double)'} as named from cells group by {m})")
        rest = f"(select greatest(1 - coalesce(sum(named), 0), 0) / sum(free) filter (named is null) from free_{m})"
        ctes.append(f"raw_{m} as (select {m}, coalesce(named, free * {rest}) as goal from free_{m})")
        ctes.append(f"goal_{m} as materialized (select {m}, goal / sum(goal) over () as goal_{m} from raw_{m})")
    ctes.append("w0 as materialized (select cells.*, goal_source, goal_lang, goal_topic, tokens / sum(tokens) over () as weight from cells join goal_source using (source) join goal_lang using (lang) join goal_topic using (topic))")
    step = "w"
    for m in MARGINS:
        step = f"(select * replace (weight * goal_{m} / sum(weight) over (partition by {m}) as weight) from {step})"
    ctes.append(f"w as (select *, 0 as round from w0 union all select * replace (round + 1 as round) from {step} where round < {rounds})")
    ctes.append(f"wn as materialized (select * from w where round = {rounds})")
    ctes.append(f"c0 as materialized (select {keep} * sum(tokens) as c, {keep} * sum(tokens) as budget from wn)")
    for i in range(20):
        ctes.append(f"c{i + 1} as materialized (select greatest(any_value(c), coalesce((any_value(budget) - coalesce(sum(tokens) filter (weight / tokens * c >= 1), 0)) / nullif(sum(weight) filter (weight / tokens * c < 1), 0), 0)) as c, any_value(budget) as budget from wn, c{i})")
    ctes.append("probs as (select source, lang, topic, weight, least(1.0, weight / tokens * c) as prob from wn, c20)")
    return f"with recursive {', '.join(ctes)} select {columns} from docs1 d join probs p on coalesce(d.source, chr(1)) = p.source and coalesce(d.lang, chr(1)) = p.lang and d.topic = p.topic where cast(('0x' || substr(md5('{seed}' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) / 4294967296.0 < prob"
