"""Itemised score of a relationship."""

from __future__ import annotations

#: Weights of the signals.
WEIGHTS = {"type": 0.18, "name": 0.22, "coverage": 0.30, "parent_uniqueness": 0.20, "cardinality": 0.10}


def score(type_compat: float, name: float, coverage: float, parent_uniqueness: float, child_null_ratio: float = 0.0, pattern_mismatch: bool = False, parent_coverage: float = 1.0, parent_distinct: int = 0, dense_integers: bool = False, parent_is_key: bool = True) -> dict:
    """Signals, penalties, score, confidence and whether two columns merely share a small domain."""
    signals = {"type": type_compat, "name": name, "coverage": coverage, "parent_uniqueness": parent_uniqueness, "cardinality": 1.0 if parent_uniqueness >= 0.99 else 0.5}
    coincidence = parent_distinct < 20 and not parent_is_key
    checks = (
        ("child_nulls", child_null_ratio > 0.3, -0.08), ("pattern_mismatch", pattern_mismatch, -0.10), ("low_parent_coverage", parent_coverage < 0.1 and parent_distinct >= 20, -0.20),
        ("dense_integers", dense_integers, -0.25), ("shared_domain", coincidence, -0.25),
    )
    penalties = [{"reason": r, "delta": d} for r, on, d in checks if on]
    total = min(1.0, max(0.0, sum(WEIGHTS[k] * v for k, v in signals.items()) + sum(p["delta"] for p in penalties)))
    confidence = "high" if total >= 0.8 and not coincidence else "medium" if total >= 0.6 else "low"
    return {"signals": signals, "penalties": penalties, "score": total, "confidence": confidence, "domain_coincidence": coincidence}


def classify(coverage: float, coincidence: bool = False) -> str | None:
    if coverage < 0.3:
        return None
    if coincidence:
        return "domain_coincidence"
    return "solid" if coverage >= 0.98 else "broken_integrity" if coverage >= 0.75 else "partial"


def cardinality(child_uniqueness: float, parent_uniqueness: float) -> str:
    return {(True, True): "1:1", (False, True): "N:1", (True, False): "1:N", (False, False): "N:M"}[child_uniqueness >= 0.99, parent_uniqueness >= 0.99]
