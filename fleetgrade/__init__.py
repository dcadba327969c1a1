"""fleetgrade: best-practice assessment of a fleet of lakehouse workspaces on Spark.

Every result is a DataFrame keyed by ``workspace_id``: deep operational metrics
(billing, cluster timeline, job runs, query history, audit), inventory features,
140 rule scores, pillar roll-ups and report tables. All work is expressed with the
DataFrame API so Catalyst plans it; nothing is collected to the driver.

Main entry points::

    from fleetgrade import AssessConfig, assess
    a = assess(inventory_tables, operational_tables, AssessConfig(as_of=...))
    a.scores, a.inputs, a.assessment, a.pillar_scores
"""

from fleetgrade.config import AssessConfig


def assess(inventory, operational, cfg, materialize: bool = True):
    """Run the fleet assessment (see ``fleetgrade.plans.assess.assess``)."""
    from fleetgrade.plans.assess import assess as _assess
    return _assess(inventory, operational, cfg, materialize)


__all__ = ["AssessConfig", "assess"]
