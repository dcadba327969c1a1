"""Mixing sources to target weights by iterative proportional fitting (operator 8, native).

Documents are counted into cells (source, language, topic) with their words as tokens. One
token budget, ``kept_share`` of all tokens, is stated; it sets everything else. Each name of a
dimension has a goal, its target share of the budget; a name with fewer tokens than that gives
all it has and its rest goes to the others in proportion to their targets, so the goals of a
dimension sum to the budget. Cells are then raked to the goals per language, topic and source
in turn, and no cell ever rises above its own tokens (a probability above 1). There is no
threshold on the size of a cell: a cell's tokens enter goals and caps continuously, and a rare
name can take no more from the others than its own tokens.

Raking ends when every marginal is within ``TOLERANCE`` of its goal, or when a sweep no longer
moves ``STALLED`` of the budget: the caps of the cells then leave no table with these marginals.
That is reported by a warning (``strict`` raises), and ``marginals`` gives the reached tokens of
every name beside its goal. A document is kept with its cell's calibrated probability, decided by
a hash of its id and text, so equal runs keep equal rows; no row is repeated.

Targets come as {name: share} per dimension; without one, a dimension's target is its
share in the data to the power ``ALPHA`` (below 1 flattens hot sources), brought to sum 1.
Names without documents get no tokens and their share goes to the others in proportion.

Scale: one pass counts cells with map-side aggregation, so a hot source is one row per
task and cell. The cell table (sources x languages x topics) is written once per sweep;
only a sweep's largest error and total change reach the driver. Documents meet their cell through a
broadcast of at most ``BROADCAST_CELLS`` counted cells; beyond that through a join by cell,
whose hot cells adaptive execution splits.

Edge cases: null source, language or text count as the empty name or text; documents
without words weigh nothing in the fit and get their cell's probability (1 if the cell has
no tokens); repeated rows are separate documents that share one decision; extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.llm.common import SPACE, text_of
from fleetgrade.session import cut_lineage

ALPHA = {"source": 0.5, "lang": 0.7, "topic": 1.0}
KEPT_SHARE = 0.5                      # of all tokens: the budget without a caller's own
TOLERANCE, STALLED = 1e-3, 1e-5
DIMS = ("_lang", "_topic", "_source")
_U = 1 << 40
BROADCAST_CELLS = 100_000   # cells (three short names and a number) that may be broadcast


def tokens_of(text: Column) -> Column:
    """Number of words of a text."""
    t = F.regexp_replace(text, SPACE + "+", " ")
    return (F.length(F.trim(t)) - F.length(F.translate(F.trim(t), " ", "")) + F.when(F.trim(t) == "", 0).otherwise(1)).cast("long")


def topic_of(text: Column) -> Column:
    """A plain topic by form: the first rule that fits (numbers, markup, lists, long or short prose)."""
    n = F.greatest(F.length(text), F.lit(1))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    marks = n - F.length(F.translate(text, "#*$%&|<>{}[]=;", ""))
    lines = n - F.length(F.translate(text, "\n", ""))
    return (F.when(digits * 20 > n, "numbers").when(marks * 25 > n, "markup").when(lines * 60 > n, "lists")
            .when(F.length(text) >= 2000, "long prose").otherwise("short prose"))


def with_cells(docs: DataFrame) -> DataFrame:
    """Each row as a struct ``_row``, with its cell, tokens and the hash that decides on it."""
    text = text_of()
    return docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), topic_of(text).alias("_topic"),
        tokens_of(text).alias("_tokens"), F.xxhash64("doc_id", "text").alias("_turn"))


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None) -> DataFrame:
    """``dim, n, target``: tokens and target share of every name with tokens."""
    spark, name = cells.sparkSession, dim[1:]
    have = cells.where("tokens > 0").groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
    if given is not None:
        rows = spark.createDataFrame([(str(k), float(v)) for k, v in given.items()] or [("", 0.0)], f"{dim} string, target double")
        have = have.join(rows, dim)
    else:
        have = have.withColumn("target", F.pow("n", F.lit(ALPHA[name])))
    total = have.agg(F.sum("target")).first()[0] or 1.0
    return have.select(dim, "n", (F.col("target") / F.lit(total)).alias("target"))


def level(rows: DataFrame, size: str, weight: str, budget: float) -> float:
    """The rate with ``sum(min(size, rate * weight)) = budget`` (or all sizes, if they sum to less)."""
    rate, rows = 0.0, rows.where((F.col(size) > 0) & (F.col(weight) > 0))
    # The sum is concave in the rate, so each step ends at or below the budget and only fills whole rows.
    while True:
        whole = F.col(weight) * F.lit(rate) >= F.col(size)
        full, free = rows.agg(F.sum(F.when(whole, F.col(size))), F.sum(F.when(~whole, F.col(weight)))).first()
        more = (budget - (full or 0)) / free if free else 0.0
        if more <= rate * (1 + 1e-12):
            return rate if free else max(rate, rows.agg(F.max(F.col(size) / F.col(weight))).first()[0] or 0.0)
        rate = more


def fit(cells: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, kept_share: float | None = None,
        strict: bool = False) -> DataFrame:
    """``cells`` (_source, _lang, _topic, tokens) with their raked ``kept`` tokens, at most ``tokens``."""
    targets = targets or {}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    budget = (KEPT_SHARE if kept_share is None else kept_share) * total
    now = cells.withColumn("kept", F.col("tokens") * F.lit(budget / max(1, total)))
    if not total:
        return now
    goal, room = {}, []
    for d in DIMS:
        names = cut_lineage(_targets(cells, d, targets.get(d[1:])), "goal")
        rate = level(names, "n", "target", budget)
        goal[d] = cut_lineage(names.select(d, F.least("n", F.col("target") * F.lit(rate)).alias("goal")), "goal")
        room.append(goal[d].agg(F.sum("goal")).first()[0] or 0.0)
    # Names with a target may hold less than the budget: the least room of a dimension is what all can meet.
    scale = {d: min(room) / r if r else 0.0 for d, r in zip(DIMS, room)}
    while True:
        worst, before = F.lit(0.0), F.col("kept").alias("before")
        now = now.select(*DIMS, "tokens", "kept", before)
        for d in DIMS:
            have = now.groupBy(d).agg(F.sum("kept").alias("have"))
            factor = have.join(goal[d], d, "left").select(
                d, F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) * F.lit(scale[d]) / F.col("have")).otherwise(0.0).alias("f"))
            raised = F.col("kept") * F.col("f")
            now = (now.join(factor, d).withColumn("kept", F.when(raised >= F.col("tokens") * F.lit(1 - 1e-9), F.col("tokens").cast("double"))
                                                  .otherwise(raised)).withColumnRenamed("f", f"f{d}"))
            worst = F.greatest(worst, F.when(F.col("kept") > 0, F.abs(F.col(f"f{d}") - 1)).otherwise(0.0))
        now = cut_lineage(now.select(*DIMS, "tokens", "kept", worst.alias("worst"), F.abs(F.col("kept") - F.col("before")).alias("moved")), "rake")
        error, moved = now.agg(F.max("worst"), F.sum("moved")).first()
        if (error or 0.0) <= TOLERANCE:
            break
        if (moved or 0.0) <= STALLED * budget:
            message = f"mixing: the cells' tokens allow no table with these marginals; largest relative error {error:.3g}, see marginals()"
            if strict:
                raise ValueError(message)
            warnings.warn(message, stacklevel=2)
            break
    return now.select(*DIMS, "tokens", "kept")


def marginals(raked: DataFrame, targets: dict | None = None) -> DataFrame:
    """``dimension, name, tokens, target, reached``: target and reached shares of the kept tokens."""
    out = None
    total = raked.agg(F.sum("kept")).first()[0] or 1.0
    for d in DIMS:
        reached = raked.groupBy(d).agg(F.sum("tokens").alias("tokens"), (F.sum("kept") / F.lit(total)).alias("reached"))
        rows = reached.join(_targets(raked, d, (targets or {}).get(d[1:])).drop("n"), d, "left").select(
            F.lit(d[1:]).alias("dimension"), F.col(d).alias("name"), "tokens", F.coalesce("target", F.lit(0.0)).alias("target"), "reached")
        out = rows if out is None else out.unionByName(rows)
    return out


def calibrate(docs: DataFrame, targets: dict | None = None, kept_share: float | None = None) -> DataFrame:
    """Rows of ``docs`` as ``_row``, with their cell, ``_tokens``, ``_prob`` and ``_kept``."""
    return calibrated(with_cells(docs), targets, kept_share)


def calibrated(rows: DataFrame, targets: dict | None = None, kept_share: float | None = None) -> DataFrame:
    """``rows`` of ``with_cells`` with their ``_prob`` and ``_kept``."""
    cells = cut_lineage(rows.groupBy(*DIMS).agg(F.sum("_tokens").alias("tokens")), "cells")
    raked = fit(cells, targets, kept_share)
    probs = raked.select(*DIMS, F.coalesce(F.when(F.col("tokens") > 0, F.col("kept") / F.col("tokens")), F.lit(1.0)).alias("_prob"))
    turn = F.pmod("_turn", F.lit(_U)) / F.lit(float(_U))
    if raked.count() <= BROADCAST_CELLS:
        probs = F.broadcast(probs)
    return (rows.join(probs, list(DIMS)).withColumn("_kept", turn < F.col("_prob")))


def sample(docs: DataFrame, targets: dict | None = None, kept_share: float | None = None) -> DataFrame:
    """The kept rows of ``docs``, with its own columns."""
    return calibrate(docs, targets, kept_share).where("_kept").select("_row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # No text is needed after the cells are known: one pass over the texts, written without them.
    rows = cut_lineage(with_cells(docs).withColumn("_row", F.struct("_row.doc_id")), "mixing-rows")
    return calibrated(rows).select(F.col("_row.doc_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"),
                                  F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                                  F.round("_prob", 9).alias("prob"), F.col("_kept").alias("kept"))
