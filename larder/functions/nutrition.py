"""The health index and per-portion arithmetic, as column expressions shared by every path."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.exprs import null_greatest, null_least
from larder.schemas import NUTRIENTS

#: Daily references of the index.
PROTEIN_REF, FIBER_REF = 50.0, 30.0
RISKS = {"sugar_g": (50.0, 1.2), "saturated_fats_g": (20.0, 1.0), "sodium_mg": (2000.0, 1.5)}
MICROS = {"calcium_mg": 1000.0, "iron_mg": 18.0, "magnesium_mg": 350.0, "potassium_mg": 3500.0, "vitc_mg": 90.0}
RISK_SHARE, BENEFIT_SHARE, MICRO_SHARE = 0.4, 0.4, 0.2

Values = Callable[[str], Column] | Mapping[str, Column]


def _of(values: Values) -> Callable[[str], Column]:
    return values if callable(values) else values.__getitem__


def normalized(value: Column, ref: float) -> Column:
    """value / ref, at most 1; null for null."""
    return null_least(value / ref, F.lit(1.0))


def penalized(value: Column, ref: float, alpha: float) -> Column:
    """1 - value/ref up to the reference, then -alpha (value/ref - 1)."""
    return F.when(value <= ref, 1.0 - value / ref).when(value > ref, -alpha * (value / ref - 1.0))


def benefit_score(values: Values = F.col) -> Column:
    get = _of(values)
    return (normalized(get("protein_g"), PROTEIN_REF) + normalized(get("fiber_g"), FIBER_REF)) / 2.0


def risk_score(values: Values = F.col) -> Column:
    """Mean of the three penalised terms; each negative term counts as 0."""
    get = _of(values)
    terms = [null_greatest(penalized(get(n), ref, alpha), F.lit(0.0)) for n, (ref, alpha) in RISKS.items()]
    return (terms[0] + terms[1] + terms[2]) / 3.0


def micro_score(values: Values = F.col) -> Column:
    get = _of(values)
    terms = [normalized(get(n), ref) for n, ref in MICROS.items()]
    return (terms[0] + terms[1] + terms[2] + terms[3] + terms[4]) / 5.0


def health_index(values: Values = F.col) -> Column:
    """0 to 100; null if any nutrient it needs is null."""
    return mixed(risk_score(values), benefit_score(values), micro_score(values))


def mixed(risk: Column | str, benefit: Column | str, micro: Column | str) -> Column:
    """The index of its three parts."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return null_greatest(RISK_SHARE * col(risk) + BENEFIT_SHARE * col(benefit) + MICRO_SHARE * col(micro), F.lit(0.0)) * 100.0


def zero_filled(values: Values = F.col) -> Callable[[str], Column]:
    get = _of(values)
    return lambda n: F.coalesce(get(n), F.lit(0.0))


def contribution(qty_g: Column, per_100: Column) -> Column:
    """Amount of a nutrient in ``qty_g`` grams; a null nutrient or quantity adds nothing."""
    return F.coalesce(qty_g, F.lit(0.0)) * F.coalesce(per_100, F.lit(0.0)) / 100.0


def scale_nutrition(factor: Column, suffix: str = "") -> list[Column]:
    """The thirteen nutrients times a factor."""
    return [(F.col(n) * factor).alias(f"{n}{suffix}") for n in NUTRIENTS]
