"""Probability and triage columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(score: Column, midpoint: float = 0.25, steepness: float = 5.0) -> Column:
    """Logistic squash of a raw score, with the exponent held within +-700."""
    power = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (score - F.lit(midpoint)) * F.lit(-steepness)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(power))


def severity(threat_class: Column) -> Column:
    return F.when(threat_class.isin("recon_scanning", "dga_dns_tunneling"), "medium").otherwise("high")


def confidence_tier(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
