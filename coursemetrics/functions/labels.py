"""Risk tiers, labels and suggested interventions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from coursemetrics.functions.rounding import _c

# Thresholds and texts the reports must reproduce.
HIGH_RISK = 0.65
MEDIUM_RISK = 0.40
INTERVENTION_TEXTS = {
    "high_long_inactive": "Send re-engagement email + offer 1:1 coaching session",
    "high": "Proactive check-in from manager; highlight upcoming module value",
    "medium_inactive": "Automated reminder + link to module summary",
    "medium": "Peer study group recommendation",
    "on_track": "On track — no intervention needed",
}
SKILL_TARGET = 3.5
SKILL_RED_BELOW = 2.5


def risk_tier_cut(risk) -> Column:
    """Right-closed bins (0, .40] Low, (.40, .65] Medium, (.65, 1] High; 0 or NULL -> NULL."""
    r = _c(risk)
    return (F.when((r > 0) & (r <= MEDIUM_RISK), "Low")
            .when((r > MEDIUM_RISK) & (r <= HIGH_RISK), "Medium")
            .when((r > HIGH_RISK) & (r <= 1.0), "High"))


def risk_label(risk, missing: str | None = None) -> Column:
    """>= .65 High, >= .40 Medium, else Low. NULL gives ``missing``."""
    r = _c(risk)
    out = F.when(r >= HIGH_RISK, "High").when(r >= MEDIUM_RISK, "Medium").when(r.isNotNull(), "Low")
    return out.otherwise(F.lit(missing)) if missing is not None else out


def suggested_intervention(risk, days_inactive=None) -> Column:
    """A missing risk falls through to "On track" (as NaN compares false)."""
    r = _c(risk)
    d = F.coalesce(_c(days_inactive), F.lit(0)) if days_inactive is not None else F.lit(0)
    t = INTERVENTION_TEXTS
    return (F.when((r >= HIGH_RISK) & (d > 14), t["high_long_inactive"])
            .when(r >= HIGH_RISK, t["high"])
            .when((r >= MEDIUM_RISK) & (d > 7), t["medium_inactive"])
            .when(r >= MEDIUM_RISK, t["medium"])
            .otherwise(t["on_track"]))


def skill_band(level) -> Column:
    lv = _c(level)
    return F.when(lv < SKILL_RED_BELOW, "red").when(lv < SKILL_TARGET, "yellow").otherwise("green")
