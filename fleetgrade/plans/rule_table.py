"""Rules as data.

A rule table has one row per branch: ``rule_id, seq, condition, score, verified, note,
quick_fix`` and, for a rule that the catalogue does not have, ``name, pillar, principle, ord``.
``condition`` is a SQL predicate over the input row (NULL on the last branch), ``note`` a text
in which ``{column}`` stands for a value. Branches of a rule are tried by ``seq``.

The table is checked as a whole before anything is planned: every condition must parse and be
boolean, every column it or a note names must be in the inputs, scores are 0 to 2, only a 1 may
be unverified, the last branch (and only it) has no condition, a new rule has its catalogue
columns and a pillar that exists. All faults come in one error, each with its rule and branch.

A table is static reference data like the catalogue: ``MAX_BRANCHES`` bounds what is read to
the driver, more raises. Rules are evaluated like built-in ones, one projection per pillar.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.plans import scoring
from fleetgrade.plans.catalog import PILLARS, rules as catalog_rules

MAX_BRANCHES = 10_000
WS = "workspace_id"
SCHEMA = ("rule_id string, seq int, condition string, score int, verified boolean, note string, quick_fix boolean, "
          "name string, pillar string, principle string, ord int")
_SLOT = re.compile(r"\{(\w+)\}")


class RuleTableError(ValueError):
    """All faults of a rule table, one per line."""


def read_rules(table: DataFrame, inputs: DataFrame) -> dict[str, tuple[tuple, list[dict]]]:
    """Checked rules: id -> ((ord, id, name, pillar, principle), branches in order)."""
    have = set(table.columns)
    rows = table.select(*[F.col(f.split()[0]) if f.split()[0] in have else F.lit(None).cast(f.split()[1]).alias(f.split()[0])
                          for f in SCHEMA.split(", ")]).limit(MAX_BRANCHES + 1).collect()
    if len(rows) > MAX_BRANCHES:
        raise RuleTableError(f"a rule table may hold {MAX_BRANCHES} branches")
    known = {r[1]: r[:5] for r in catalog_rules()}
    pillars = {p[1] for p in PILLARS}
    nothing = inputs.limit(0)
    by_rule: dict[str, list[dict]] = {}
    for r in rows:
        by_rule.setdefault(r["rule_id"], []).append(r.asDict())
    faults, out = [], {}
    for rid, branches in sorted(by_rule.items(), key=lambda x: str(x[0])):
        branches.sort(key=lambda b: (b["seq"] is None, b["seq"]))
        say = lambda b, what: faults.append(f"{rid} branch {b['seq']}: {what}")  # noqa: E731,B023
        first = branches[0]
        if not rid or len({b["seq"] for b in branches}) < len(branches):
            say(first, "needs a rule_id and distinct seq numbers")
        head = known.get(rid)
        own = tuple(next((b[c] for b in branches if b[c] is not None), head[i] if head else None)
                    for i, c in ((0, "ord"), (2, "name"), (3, "pillar"), (4, "principle")))
        if None in own:
            say(first, "is not in the catalogue and lacks ord, name, pillar or principle")
        elif own[2] not in pillars:
            say(first, f"unknown pillar {own[2]!r}")
        for b in branches:
            last = b is branches[-1]
            if last != (b["condition"] is None):
                say(b, "only the last branch has no condition" if not last else "the last branch must have no condition")
            if b["score"] not in (0, 1, 2) or b["verified"] is None or (not b["verified"] and b["score"] != 1):
                say(b, f"score {b['score']} with verified {b['verified']}: scores are 0 to 2 and only a 1 may be unverified")
            for slot in _SLOT.findall(b["note"] or ""):
                if slot not in inputs.columns:
                    say(b, f"note names {slot!r}, which the inputs do not have")
            if b["condition"] is not None:
                try:
                    kind = nothing.select(F.expr(b["condition"]).alias("c")).dtypes[0][1]
                    if kind != "boolean":
                        say(b, f"condition is {kind}, not boolean")
                except ParseException as e:
                    say(b, f"condition does not parse: {e.getMessage().splitlines()[0]}")
                except AnalysisException as e:
                    say(b, f"condition does not fit the inputs: {e.getMessage().splitlines()[0]}")
        out[rid] = ((own[0], rid, *own[1:]), branches)
    if faults:
        raise RuleTableError("\n".join(faults))
    return out


def _note(text: str | None):
    parts, at = [], 0
    for m in _SLOT.finditer(text or ""):
        parts += [F.lit(text[at: m.start()]), F.coalesce(F.col(m.group(1)).cast("string"), F.lit("unknown"))]
        at = m.end()
    return F.concat(*parts, F.lit((text or "")[at:]))


def _rows(inputs: DataFrame, rules: list[tuple[tuple, list[dict]]]) -> DataFrame:
    picks, structs = [], []
    for (ord_, rid, name, pillar, principle), branches in rules:
        index = F.lit(len(branches) - 1)
        for i in range(len(branches) - 2, -1, -1):
            index = F.when(F.expr(branches[i]["condition"]), F.lit(i)).otherwise(index)
        b = f"t_{len(picks)}"
        picks.append(index.alias(b))
        one = lambda values: F.element_at(F.array(*values), F.col(b) + 1)  # noqa: E731,B023
        structs.append(F.struct(
            F.lit(ord_).alias("ord"), F.lit(rid).alias("rule_id"), F.lit(name).alias("name"), F.lit(pillar).alias("pillar"),
            F.lit(principle).alias("principle"), one([F.lit(x["score"]) for x in branches]).cast("int").alias("score"),
            one([F.lit(x["verified"]) for x in branches]).alias("verified"), one([_note(x["note"]) for x in branches]).alias("finding_notes"),
            one([F.lit(bool(x["quick_fix"])) for x in branches]).alias("quick_fix")))
    return inputs.select("*", *picks).select(WS, F.explode(F.array(*structs)).alias("r")).select(WS, "r.*")


def score_with_table(inputs: DataFrame, table: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """The scores table of the built-in rules with the table's rules added, or put in the place of those they replace."""
    rules = read_rules(table, inputs)
    out = scoring.score_rules(inputs, rule_ids=[r[1] for r in catalog_rules() if r[1] not in rules])
    by_pillar: dict[str, list] = {}
    for rule in rules.values():
        by_pillar.setdefault(rule[0][3], []).append(rule)
    for group in by_pillar.values():
        out = out.unionByName(_rows(inputs, group))
    return out if as_of is None else out.withColumn("as_of", F.lit(as_of))
