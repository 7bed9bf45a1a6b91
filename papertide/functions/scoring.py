"""Scores as column expressions. Rounded results are half up at the stated decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, decimals: int) -> Column:
    scale = 10**decimals
    return F.floor(x * scale + 0.5) / scale


def cite_per_year(citations: Column, year: Column, clock_year: int, end_year: int) -> Column:
    """Citations a year; without a year (null or 0), as if published in end_year."""
    age = F.greatest(F.lit(clock_year) - F.coalesce(F.nullif(year, F.lit(0)), F.lit(end_year)), F.lit(1))
    return F.coalesce(citations, F.lit(0)) / age


def norm_if(impact: Column) -> Column:
    return F.when(impact > 0, F.least(impact / 20, F.lit(1.0))).otherwise(0.0)


def impact_score(avg_cite: Column, avg_cpy: Column, avg_if: Column, q1_share: Column) -> Column:
    raw = 0.30 * F.log1p(avg_cite) + 0.30 * F.log1p(avg_cpy) + 0.20 * norm_if(avg_if) + 0.20 * q1_share
    return half_up(F.least(F.lit(3.0), raw * 1.2), 2)


def impact_tier(score: Column) -> Column:
    return F.when(score >= 2, "High").when(score >= 1, "Medium").when(score > 0, "Emerging").otherwise("Unknown")


def literature_gap_points(gap: Column) -> Column:
    return F.when(gap == "unexplored", 3).when(gap == "minimal", 2).otherwise(1)


def data_support_points(cases: Column) -> Column:
    return F.when(cases >= 500, 3).when(cases >= 200, 1).otherwise(0)


def emerging_score(recent: Column, prior: Column, avg_cpy: Column, avg_if: Column) -> Column:
    velocity = (recent - prior) / F.greatest(prior, F.lit(1))
    raw = 0.4 * F.log1p(recent) + 0.3 * F.greatest(F.lit(0.0), velocity) + 0.2 * F.log1p(avg_cpy) + 0.1 * norm_if(avg_if)
    return F.when(recent > 0, half_up(raw, 3)).otherwise(0.0)


def temporal_status(first_year: Column, last_year: Column, papers: Column, recent: Column, as_of_year: Column, recent_years: int, emerging_max_age: int, persistent_ratio: float) -> Column:
    """Ordered rules on proposal age, not on the search window; year 0 counts as no year."""
    known = (F.coalesce(first_year, F.lit(0)) != 0) & (F.coalesce(last_year, F.lit(0)) != 0) & (papers > 0)
    return (
        F.when(~known, "stable")
        .when(as_of_year - first_year <= emerging_max_age, "emerging")
        .when((recent == 0) & (last_year < as_of_year - recent_years), "declining")
        .when((recent > 0) & (half_up(recent / F.greatest(papers, F.lit(1)), 3) >= persistent_ratio), "persistent")
        .otherwise("stable")
    )


def resolution_signal(first_year: Column, last_year: Column, followups: Column, first_followup: Column, least: int) -> Column:
    return (
        F.when(followups >= least, F.when((first_followup > last_year) | (first_followup > first_year), "moderate").otherwise("weak"))
        .when(followups == 1, "weak")
        .otherwise("none")
    )


def combo_phase(recent: Column, prior: Column) -> Column:
    return F.when((prior == 0) & (recent <= 2), "nascent").when(recent > prior, "heating").when(recent >= 2, "active").otherwise("stable")


def difficulty_ordinal(level: Column) -> Column:
    return F.array_position(F.array(F.lit("easy"), F.lit("moderate"), F.lit("hard")), level) - 1


def difficulty_color(delta: Column) -> Column:
    return F.when(delta == 0, "green").when(F.abs(delta) == 1, "amber").otherwise("red")


def feasibility_status(score: Column) -> Column:
    return F.when(score >= 0.8, "APPROVED").when(score >= 0.5, "REFINED").when(score >= 0.2, "RISKY").otherwise("REJECTED_DATA_INSUFFICIENT")


def data_support_tier(cohort: Column, mapped: Column) -> Column:
    return F.when(~mapped, "none").when(cohort >= 500, "high").when(cohort >= 200, "medium").otherwise("low")


def total_priority(gap: Column, cases: Column, impact: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Points of the literature gap, of the data and of the impact, each by its weight; unknown cases and impact count as 0."""
    points = literature_gap_points(gap) * weights[0] + data_support_points(F.coalesce(cases, F.lit(0))) * weights[1] + F.coalesce(impact, F.lit(0.0)) * weights[2]
    return half_up(points, 2)


def recommendation(score: Column, cohort: Column) -> Column:
    return F.when((score >= 0.8) & (cohort >= 500), "FEASIBLE").when((score >= 0.5) | (cohort >= 200), "MARGINAL").when((score >= 0.2) | (cohort >= 50), "RISKY").otherwise("INSUFFICIENT")


def recommendation_note(recommended: Column, score: Column, cohort: Column) -> Column:
    """What a recommendation means for a cohort; the wordings are fixed values."""
    return (
        F.when(recommended == "FEASIBLE", F.format_string("%d例满足全部条件，建议80/20训练测试划分后训练集%d例，可支撑深度学习建模", cohort, F.floor(cohort * 0.8)))
        .when(recommended == "MARGINAL", F.concat(F.format_string("%d例可用，建议结合迁移学习或数据增强（feasibility_score=", cohort), score.cast("string"), F.lit("）")))
        .when(recommended == "RISKY", F.format_string("仅%d例满足条件，风险较高，建议调整假说范围", cohort))
        .otherwise(F.format_string("数据不足（%d例），Idea 降级或舍弃", cohort))
    )


def is_positive(result: Column) -> Column:
    """Whether a result's wording is positive; a negative wording outweighs it. The wordings are fixed values."""
    low = F.lower(F.trim(F.coalesce(result, F.lit(""))))
    says = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return ~says("阴", "negative") & says("阳性", "positive", "+", "阳")
