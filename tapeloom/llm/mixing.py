"""Mixing sources to target weights: token weights raked to several marginals, documents sampled by them."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh, kept, safe_unions

C = F.col
NONE = "(none)"
AXES = ("source", "lang", "topic")
#: Targets are each value's token share to this power, brought to sum 1: 1 keeps the mix, 0 levels it.
DAMPING = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 8
#: Rounds of raking below the bound, at most, and the part of the budget by which a share may miss its target.
MOST = 32
CLOSE = 1e-4
#: Rounds between two looks at what is missed; ``MOST`` is a multiple of it.
EACH = 4
SHARE = 0.6
#: Tables of cells up to this many rows are read as one partition, so that the rounds need no shuffle.
FEW = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
LONG = 8000


def topic_of(text: Column) -> Column:
    """The form of a text: table, notice, long or prose."""
    low = F.lower(text)
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(low, F.lit("licen")) | F.contains(low, F.lit("copyright")), "notice")
        .when(F.length(text) >= LONG, "long")
        .otherwise("prose")
    )


def _described(docs: DataFrame) -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        topic_of(text).alias("topic"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint").alias("tokens"),
    ]


def damped(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """axis value, share: token shares raised to ``power`` and brought to sum 1."""
    own = cells.groupBy(axis).agg(F.sum("tokens").alias("own")).filter(C("own") > 0)
    raised = own.withColumn("raised", F.pow(C("own").cast("double"), power))
    total = raised.agg(F.sum("raised").alias("total"))
    return raised.select(axis, (C("raised") / total.scalar()).alias("share"))


def gathered(cells: DataFrame) -> DataFrame:
    """A written table of cells, in one partition if its size allows."""
    return cells.coalesce(1) if cells.count() <= FEW else cells


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: tokens scaled, axis by axis and round by round, to each axis' target shares.

    Cells are the crossings of the axes, counted before; each round is written to the shared folder, and
    nothing but its plan stays on the driver. A value without target gets weight zero. When targets
    contradict each other the last axis of ``targets`` is met exactly.
    """
    cells = cells.withColumn("weight", C("tokens").cast("double"))
    for _ in range(rounds):
        for axis, target in targets.items():
            now = cells.groupBy(axis).agg(F.sum("weight").alias("now"))
            factor = now.join(target, axis).select(axis, F.when(C("now") > 0, C("share") / C("now")).otherwise(0.0).alias("factor"))
            cells = cells.join(factor, axis, "left").withColumn("weight", C("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        cells = kept(cells, "cells")
    return cells


def calibrated(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """``cells`` with ``probability``, proportional to weight per token, at most 1, so that ``share`` of all tokens is expected.

    What a full cell cannot give is asked of the others; three sums a round reach the driver. A cell
    without tokens has probability zero.
    """
    rate = F.when(C("tokens") > 0, C("weight") / C("tokens")).otherwise(0.0)
    cells = cells.withColumn("rate", rate)
    budget = share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    scale, full = 0.0, None
    while True:
        over = C("rate") * scale >= 1
        row = cells.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, C("tokens"))).alias("given"), F.sum(F.when(~over, C("weight"))).alias("open")
        ).first()
        if row["n"] == full or not row["open"]:
            break
        full = row["n"]
        scale = (budget - (row["given"] or 0)) / row["open"]
    return cells.withColumn("probability", F.least(F.lit(1.0), C("rate") * scale)).drop("rate")


def attainable(cells: DataFrame, axis: str, power: float, share: float = SHARE) -> DataFrame:
    """axis value, target: tokens of the sample by ``damped`` shares; what a value has too little for is asked of the others alike."""
    own = cells.groupBy(axis).agg(F.sum("tokens").alias("tokens")).filter(C("tokens") > 0)
    asked = gathered(kept(own.join(damped(cells, axis, power).withColumnRenamed("share", "weight"), axis), "asked"))
    return calibrated(asked, share).select(axis, (C("probability") * C("tokens")).alias("target"))


def _filled(cells: DataFrame, axis: str, few: bool) -> DataFrame:
    """Adds what the full cells of each value of an axis hold, and what its other cells weigh."""
    full = C("weight") >= C("tokens")
    held = F.sum(F.when(full, C("tokens")).otherwise(0)).cast("double")
    rest = F.sum(F.when(full, 0.0).otherwise(C("weight")))
    if few:  # in one partition the windows need no shuffle, and the plan does not branch
        each = Window.partitionBy(axis)
        held = F.sum(F.when(full, C("tokens")).otherwise(0)).over(each).cast("double")
        return cells.withColumns({"held": held, "rest": F.sum(F.when(full, 0.0).otherwise(C("weight"))).over(each)})
    return cells.join(cells.groupBy(axis).agg(held.alias("held"), rest.alias("rest")), axis)


def raked_below(cells: DataFrame, targets: dict[str, DataFrame], share: float = SHARE, most: int = MOST, close: float = CLOSE) -> DataFrame:
    """``cells`` with ``weight``: tokens expected in the sample, raked to each axis' ``target`` and nowhere above the cell's tokens.

    Full cells count with their tokens and the rest is raked to what is left of each target; a full cell's
    own weight moves along, so that it opens again where that is too much. After every ``EACH`` rounds one row
    tells the driver by how much the last of them missed a target; that ends them when it is no more than ``close`` of
    the budget. Targets that are not met after ``most`` rounds are told in a warning, with the part of the budget missed.
    """
    few = cells.count() <= FEW
    cells = cells.withColumn("weight", C("tokens") * F.lit(float(share)))
    for axis, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"target_{axis}"), axis, "left")
    cells = kept(cells, "cells")
    for k in range(most):
        cells = (cells.coalesce(1) if few and k % EACH == 0 else cells).withColumn("missed", F.lit(0.0))
        for axis in targets:
            target, got = C(f"target_{axis}"), C("held") + C("rest")
            cells = _filled(cells, axis, few)
            factor = F.when((target >= got) & (C("rest") > 0), (target - C("held")) / C("rest")).when(target.isNotNull() & (got > 0), target / got)
            new = C("weight") * F.coalesce(factor, F.lit(0.0))
            cells = cells.withColumns({"weight": new, "missed": F.greatest("missed", F.abs(target - got))}).drop("held", "rest")
        ends = (k + 1) % EACH == 0 or k + 1 == most
        if not few or ends:
            cells = kept(cells, "cells")
        if ends:
            row = cells.agg(F.max("missed").alias("missed"), F.sum("tokens").alias("tokens")).first()
            if (row["missed"] or 0) <= close * share * (row["tokens"] or 0):
                break
    else:
        warnings.warn(f"raking ended after {most} rounds; a target is missed by {row['missed'] / (share * row['tokens']):.6f} of the budget", stacklevel=2)
    cells = cells.withColumn("weight", F.least("weight", C("tokens").cast("double")))
    return gathered(kept(cells.drop("missed", *[f"target_{axis}" for axis in targets]), "cells"))


def drawn(key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key as text; null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cell_table(described: DataFrame) -> DataFrame:
    return described.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _mix(described: DataFrame, share: float, rounds: int, bounded: bool) -> DataFrame:
    cells = gathered(kept(cell_table(described), "cells"))
    if bounded:
        reach = {axis: gathered(kept(attainable(cells, axis, power, share), "targets")) for axis, power in DAMPING.items()}
        return kept(calibrated(raked_below(cells, reach, share), share), "mix").select(*AXES, "probability")
    targets = {axis: kept(damped(cells, axis, power), "targets") for axis, power in DAMPING.items()}
    return kept(calibrated(raked(cells, targets, rounds), share), "mix").select(*AXES, "probability")


def mixed(docs: DataFrame, share: float = SHARE, rounds: int = ROUNDS, bounded: bool = True) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, selected for every row.

    Tokens are words between ASCII white space. Null sources and languages form the value ``(none)``,
    null texts count as empty. The draw depends on doc_id alone, so repeated rows share their fate; a
    null doc_id draws as the empty text. Empty texts cost nothing and are sampled like their cell, a
    cell without any token is not sampled. An empty table gives an empty result.

    ``bounded`` rakes below probability 1, so that the sample has the target shares as far as the tokens
    reach; without it ``rounds`` of free raking are cut at 1 afterwards, which misses them.
    """
    safe_unions(docs.sparkSession)
    described = kept(docs.select("doc_id", *_described(docs)), "described")
    out = described.join(_mix(described, share, rounds, bounded), list(AXES))
    return out.select(
        "doc_id", *AXES, "tokens", F.round("probability", 9).alias("probability"), (drawn(C("doc_id")) < C("probability")).alias("selected")
    )


def sampled(docs: DataFrame, share: float = SHARE, rounds: int = ROUNDS, bounded: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, that are drawn; by the probabilities of ``mixed``."""
    safe_unions(docs.sparkSession)
    described = kept(docs.select("doc_id", *_described(docs)), "described")
    names = {axis: fresh(docs, f"{axis}_of_cell") for axis in AXES}
    chance = fresh(docs, "chance")
    mix = _mix(described, share, rounds, bounded).select(*[C(a).alias(n) for a, n in names.items()], C("probability").alias(chance))
    cell = {n: c for n, c in zip(names.values(), _described(docs))}
    rows = docs.withColumns(cell).join(mix, list(names.values()))
    return rows.filter(drawn(C("doc_id")) < C(chance)).select(*docs.columns)


def _scale_sql(rows: str, name: str, share: float, rounds: int = 12) -> list[str]:
    """Scales of ``calibrated`` for the table ``rows`` (tokens, weight, rate), step by step; the last is ``{name}{rounds}``."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS scale)"]
    for k in range(rounds):
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(sum(CASE WHEN rate * scale < 1 THEN weight END), 0) > 0 THEN "
            f"({share} * sum(tokens) - coalesce(sum(CASE WHEN rate * scale >= 1 THEN tokens END), 0)) / sum(CASE WHEN rate * scale < 1 THEN weight END) "
            f"ELSE max(scale) END AS scale FROM {rows}, {name}{k})"
        )
    return parts


def mixing_sql(share: float = SHARE, most: int = MOST, close: float = CLOSE, table: str = "documents") -> str:
    """``mixed`` in DuckDB's SQL: the rounds are unrolled, and those after the last that is needed change nothing."""
    axes = ", ".join(AXES)
    parts = [
        f"""described AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
             WHEN contains(lower(text), 'licen') OR contains(lower(text), 'copyright') THEN 'notice'
             WHEN length(text) >= {LONG} THEN 'long' ELSE 'prose' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM {table})""",
        f"c0 AS MATERIALIZED (SELECT {axes}, sum(tokens)::BIGINT AS tokens, {share} * sum(tokens)::DOUBLE AS weight, 0.0::DOUBLE AS missed FROM described GROUP BY {axes})",
    ]
    for axis, power in DAMPING.items():
        parts.append(
            f"o_{axis} AS MATERIALIZED (SELECT {axis}, tokens, r / sum(r) OVER () AS weight, r / sum(r) OVER () / tokens AS rate FROM "
            f"(SELECT {axis}, sum(tokens)::BIGINT AS tokens, pow(sum(tokens)::DOUBLE, {power}) AS r FROM c0 GROUP BY {axis} HAVING sum(tokens) > 0))"
        )
        parts += _scale_sql(f"o_{axis}", f"s_{axis}", share)
        parts.append(f"t_{axis} AS MATERIALIZED (SELECT {axis}, least(1.0, rate * scale) * tokens AS target FROM o_{axis}, s_{axis}12)")
    parts.append("d0 AS MATERIALIZED (SELECT FALSE AS done)")
    step = 0
    for k in range(most):
        for n, axis in enumerate(DAMPING):
            own = f"(PARTITION BY {axis})"
            sums = f"SELECT *, sum(CASE WHEN weight >= tokens THEN tokens ELSE 0 END) OVER {own}::DOUBLE AS held, sum(CASE WHEN weight >= tokens THEN 0.0 ELSE weight END) OVER {own} AS rest FROM c{step}"
            factor = "CASE WHEN target >= held + rest AND rest > 0 THEN (target - held) / rest WHEN target IS NOT NULL AND held + rest > 0 THEN target / (held + rest) END"
            missed = "missed" if n else "0.0::DOUBLE"
            parts.append(
                f"c{step + 1} AS MATERIALIZED (SELECT {', '.join('c.' + a for a in AXES)}, c.tokens, CASE WHEN done THEN c.weight ELSE c.weight * coalesce({factor}, 0.0) END AS weight, "
                f"greatest({missed}, abs(target - (held + rest))) AS missed FROM ({sums}) c LEFT JOIN t_{axis} t ON c.{axis} = t.{axis}, d{k})"
            )
            step += 1
        met = f"bool_or(done) OR coalesce(max(missed), 0) <= {close} * {share} * sum(tokens)" if (k + 1) % EACH == 0 else "bool_or(done)"
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT {met} AS done FROM c{step}, d{k})")
    weight = "least(weight, tokens::DOUBLE)"
    parts.append(f"r AS MATERIALIZED (SELECT {axes}, tokens, {weight} AS weight, CASE WHEN tokens > 0 THEN {weight} / tokens ELSE 0.0 END AS rate FROM c{step})")
    parts += _scale_sql("r", "s", share)
    draw = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {', '.join('d.' + a for a in AXES)}, d.tokens, "
        f"round(least(1.0, r.rate * s12.scale), 9) AS probability, {draw} < least(1.0, r.rate * s12.scale) AS selected "
        f"FROM described d JOIN r ON {' AND '.join(f'd.{a} = r.{a}' for a in AXES)}, s12"
    )
