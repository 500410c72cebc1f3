"""Labels and derived columns from ordered business rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.scalars import flag


def first_match(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """Label of the first rule that holds, else the default."""
    picked = None
    for test, label in rules:
        value = F.lit(label)
        picked = F.when(test, value) if picked is None else picked.when(test, value)
    return picked.otherwise(F.lit(default))


def all_of(*tests: Column) -> Column:
    """1 where every test holds, else 0."""
    whole = tests[0]
    for test in tests[1:]:
        whole = whole & test
    return flag(whole)


def rule_else(rule: Column, fallback: Column) -> Column:
    """1 where the rule holds, else the fallback of the caller."""
    return F.when(rule, F.lit(1)).otherwise(fallback)


def weighted_score(weights: Mapping[str, float] | Sequence[tuple[Column, float]], low: float = 0.0,
                   high: float = 100.0) -> Column:
    """Whole-number score: weighted sum with missing as 0, held between ``low`` and ``high``."""
    pairs = weights.items() if isinstance(weights, Mapping) else weights
    total = sum((F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) * F.lit(w)
                 for c, w in pairs), F.lit(0.0))
    return F.floor(F.greatest(F.lit(low), F.least(total, F.lit(high)))).cast("int")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def account_health(satisfaction: Column, idle_days: Column) -> Column:
    """At risk under 2 points or idle over 180 days; attention under 4 points and over 90 days."""
    return first_match([
        ((satisfaction < 2) | (idle_days > 180), "At Risk"),
        ((satisfaction < 4) & (idle_days > 90), "Needs Attention"),
        ((satisfaction >= 4) & (idle_days <= 90), "Healthy")], "Healthy")


def company_segment(revenue: Column, staff: Column) -> Column:
    return first_match([
        ((zero(revenue) > 1_000_000) & (zero(staff) > 100), "Enterprise"),
        ((zero(revenue) > 100_000) & (zero(staff) > 10), "Mid-Market"),
        ((zero(revenue) <= 100_000) | (zero(staff) <= 10), "Small Business")], "Small Business")


def customer_tier(purchases: Column, rating: Column) -> Column:
    return first_match([
        ((purchases < 3) | (rating < 2), 0),
        ((purchases < 8) & (rating < 4), 1),
        ((purchases >= 8) & (rating >= 4), 2)], 0)


def high_value_customer(purchases: Column, rating: Column, seconds: Column) -> Column:
    return all_of(purchases > 5, rating > 3, seconds > 300)


def lead_score(open_rate: Column, forms: Column, visits: Column, seconds: Column) -> Column:
    return weighted_score([(open_rate, 20.0), (forms, 10.0), (visits, 5.0), (seconds, 1 / 60)])


def opportunity_won(stage: Column, amount: Column, fallback: Column) -> Column:
    return rule_else(stage.isin("Proposal", "Negotiation") & (amount > 5000), fallback)


def lead_converted(rating: Column, contact: Column, fallback: Column) -> Column:
    return rule_else(rating.isin("Hot", "Warm") & (contact == "Meeting"), fallback)


def campaign_answered(open_rate: Column, click_rate: Column, forms: Column, fallback: Column) -> Column:
    return rule_else(((zero(open_rate) > 0.2) & (zero(click_rate) > 0.1)) | (zero(forms) > 0), fallback)


def sales_columns(units: Column, returned: Column, price: Column, royalty: Column) -> dict[str, Column]:
    """Gross and net sales, returns and royalty, in cents."""
    gross = F.round(units * price, 2)
    returns = F.round(returned * price, 2)
    net = F.round(gross - returns, 2)
    return {"gross_sales": gross, "returns": returns, "net_units": units - returned,
            "net_sales": net, "royalty_payable": F.round(net * royalty, 2)}


def estimated_value(price: Column, discount: Column) -> Column:
    return price * (F.lit(1.0) + discount)
