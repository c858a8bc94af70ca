from coursemetrics.functions.rounding import stable_round, pct
from coursemetrics.functions.labels import (risk_tier_cut, risk_label, suggested_intervention,
                                            skill_band)
from coursemetrics.functions.lookup import pick

__all__ = ["stable_round", "pct", "risk_tier_cut", "risk_label", "suggested_intervention",
           "skill_band", "pick"]
