"""Score every rule per workspace and roll the scores up.

Scoring is one projection of 140 ``struct(score, verified, notes)`` columns over
the per-workspace input row followed by one ``explode``: no join, no shuffle.
Rule metadata (name, pillar, principle, order) is inlined as literals from the
static catalogue. Roll-ups use ``rollup(workspace_id, pillar)`` so pillar and
overall figures come from a single aggregate.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.fold import shuffled
from fleetgrade.plans.catalog import PILLARS, rules as catalog_rules
from fleetgrade.plans.rules import compile_branches

WS = "workspace_id"

# Phrases that mark a score of 1 as a default rather than evidence.
UNVERIFIABLE_PHRASES = (
    "not verifiable",
    "not fully verifiable",
    "not fully verified",
    "cannot verify",
    "cannot confirm",
    "cannot assess",
    "cannot determine",
    "requires --deep",
    "account-level and not verifiable",
    "not detectable via api",
    "not detectable from api",
)

# Columns that only the notes read.
EVIDENCE = {"always_on_rows": "bigint", "always_on_names": "string", "idle_names": "string", "p95_duration_ms": "double"}

# Maturity cut-offs on the unrounded verified mean.
MATURITY_LEVELS = ((1.75, "Optimized"), (1.25, "Established"), (0.5, "Developing"))


def _pick(values: list, idx: Column) -> Column:
    """``values[idx]`` for a short literal list."""
    if all(v == values[0] for v in values):
        return F.lit(values[0])
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


# Compiled rule expressions per (application, rule ids). They are unresolved
# Column expressions, independent of the input DataFrame, and building them
# costs thousands of JVM calls, so they are built once and reused.
_COMPILED: dict[tuple, tuple[list, list]] = {}


def clear_compiled() -> None:
    _COMPILED.clear()


def _compiled_group(group: list[tuple]) -> tuple[list, list]:
    from pyspark.sql import SparkSession
    from fleetgrade.session import app_id
    active = SparkSession.getActiveSession()
    key = (app_id(active) if active else None, tuple(r[1] for r in group))
    if key in _COMPILED:
        return _COMPILED[key]
    idx_cols, structs = [], []
    for ord_, rid, name, pillar, principle, _domains in group:
        idx, scores, flags, notes, quick = compile_branches(rid)
        b = f"b_{rid.replace('-', '_')}"
        idx_cols.append(idx.alias(b))
        note = notes[0] if len(notes) == 1 else F.element_at(F.array(*notes), F.col(b) + 1)
        structs.append(F.struct(
            F.lit(ord_).alias("ord"), F.lit(rid).alias("rule_id"), F.lit(name).alias("name"),
            F.lit(pillar).alias("pillar"), F.lit(principle).alias("principle"),
            _pick(scores, F.col(b)).cast("int").alias("score"), _pick(flags, F.col(b)).alias("verified"),
            note.alias("finding_notes"), _pick(quick, F.col(b)).alias("quick_fix")))
    _COMPILED[key] = (idx_cols, structs)
    return _COMPILED[key]


def _score_group(inputs: DataFrame, group: list[tuple]) -> DataFrame:
    idx_cols, structs = _compiled_group(group)
    wide = inputs.select("*", *idx_cols)
    return wide.select(WS, F.explode(F.array(*structs)).alias("r")).select(WS, "r.*")


def score_rules(inputs: DataFrame, as_of: dt.date | None = None,
                rule_ids: list[str] | None = None) -> DataFrame:
    """Long ``scores`` table: one row per (workspace, rule).

    Rules are evaluated one pillar at a time: each pillar's expressions are
    projected as separate columns (generated code stays small; one class with
    all 420 expressions takes seconds to compile) and an array of small structs
    over them is exploded. The pillar results are unioned; ``inputs`` is one
    row per workspace, ideally already materialised (see ``plans.assess``).
    """
    groups: dict[str, list[tuple]] = {}
    for r in catalog_rules():
        if rule_ids is None or r[1] in rule_ids:
            groups.setdefault(r[3], []).append(r)
    # Inputs stored before the evidence was carried score alike; their notes only lack it.
    gaps = [F.lit(None).cast(t).alias(c) for c, t in EVIDENCE.items() if c not in inputs.columns]
    inputs = inputs.select("*", *gaps) if gaps else inputs
    parts = [_score_group(inputs, g) for g in groups.values()]
    if not parts:
        return _score_group(inputs, [catalog_rules()[0]]).where("false")
    out = reduce(lambda a, b: a.unionByName(b), parts)
    if as_of is not None:
        out = out.withColumn("as_of", F.lit(as_of))
    return out


def reflag_verified(scores: DataFrame) -> DataFrame:
    """E2 from the note text, for scores read back from a foreign cache."""
    pattern = "|".join(p.replace("-", "\\-") for p in UNVERIFIABLE_PHRASES)
    notes = F.lower(F.coalesce(F.col("finding_notes"), F.lit("")))
    return scores.withColumn("verified", (F.col("score") != 1) | ~notes.rlike(pattern))


def maturity(c) -> F.Column:
    out = F.lit("Beginning")
    for cut, label in reversed(MATURITY_LEVELS):
        out = F.when(c >= cut, F.lit(label)).otherwise(out)
    return out


def rollups(scores: DataFrame) -> DataFrame:
    """One aggregate for pillar rows (``pillar`` set) and overall rows (``pillar`` NULL)."""
    v = F.col("verified")
    s = F.col("score").cast("double")
    agg = scores.rollup(WS, "pillar").agg(
        F.count(F.lit(1)).alias("rules"),
        F.sum(v.cast("int")).alias("verified_rules"),
        F.avg(s).alias("score_mean"),
        F.avg(F.when(v, s)).alias("verified_mean"),
        F.grouping_id().alias("_g"),
        *([F.max("as_of").alias("as_of")] if "as_of" in scores.columns else []),
    )
    return agg.where(F.col("_g") < 3).drop("_g")


def pillar_scores(scores: DataFrame) -> DataFrame:
    """Per (workspace, pillar). ``pillar_verified_score`` NULL when nothing verified."""
    r = rollups(scores).where(F.col("pillar").isNotNull())
    return r.select(
        WS, "pillar", "rules", "verified_rules",
        F.col("score_mean").alias("pillar_score"),
        F.col("verified_mean").alias("pillar_verified_score"),
        (F.col("verified_rules").cast("double") / F.col("rules").cast("double") * 100.0).alias("pillar_coverage"),
    )


def assessment(scores: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row per workspace (with ``as_of`` when the scores carry it)."""
    r = rollups(scores).where(F.col("pillar").isNull())
    vmean = F.coalesce(F.col("verified_mean"), F.lit(0.0))
    cols = [WS]
    if "as_of" in scores.columns:
        cols.append("as_of")
    out = r.select(
        *cols, "rules", "verified_rules",
        F.bround(F.col("score_mean"), 2).alias("overall_score"),
        F.bround(vmean, 2).alias("verified_score"),
        F.bround(F.col("verified_rules").cast("double") / F.col("rules").cast("double") * 100.0, 1)
        .alias("coverage_pct"),
        maturity(vmean).alias("maturity"),
    )
    if base is not None:
        out = out.join(shuffled(base.select(WS, "host", "cloud")), on=WS, how="left")
    return out


def pillar_order() -> list[str]:
    return [p[1] for p in PILLARS]
