"""The registry of the engine's models over staged events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from ..operators import cleaning, dimensions, facts, joins, sessions
from ..quality import checks, reconcile
from .registry import Registry


def build(events: DataFrame) -> Registry:
    """Models from keyed or raw events to marts, with their tests; exposures are the dashboards that read them."""
    r, spark = Registry(), events.sparkSession
    t = lambda f, *a: lambda df: f(df, *a)
    r.model("stg_events", "staging", kind="view", tests=(t(checks.not_null, "event_key"), t(checks.unique, "event_key")))(lambda: cleaning.stage_events(events))
    r.model("stg_products", "staging", ("stg_events",), kind="view", tests=(t(checks.unique, "product_id"),))(cleaning.latest_products)
    r.model("int_sessions", "intermediate", ("stg_events",), kind="view", tests=(t(checks.not_null, "session_id"), sessions.gap_violations))(sessions.sessionize)
    r.model("int_events_enriched", "intermediate", ("int_sessions", "stg_products"), kind="view", tests=(t(checks.unique, "event_key"),))(joins.enrich)
    r.model("dim_date", "core", tests=(t(checks.unique, "date_key"),))(lambda: dimensions.date_dimension(spark))
    r.model("dim_customer", "core", ("int_events_enriched",), tests=(t(checks.unique, "customer_key"),))(dimensions.customer_dimension)
    r.model("dim_product", "core", ("int_events_enriched",), tests=(t(checks.unique, "product_key"), dimensions.overlapping_versions))(dimensions.product_history)
    r.model("fact_events", "core", ("int_events_enriched", "dim_date", "dim_customer", "dim_product"), tests=(t(checks.unique, "event_key"), t(checks.not_null, "date_key")))(facts.fact_events)
    r.model("fact_purchases", "core", ("fact_events",), tests=(t(checks.unique, "purchase_key"),))(facts.fact_purchases)
    r.model("int_customer_month_activity", "intermediate", ("fact_purchases", "dim_date"))(facts.cohort_grid)
    r.model("mart_customer_retention", "marts", ("int_customer_month_activity",), tests=(lambda df: df.filter("retained_count > cohort_size"), lambda df: df.filter("months_since_first_purchase = 0 AND retention_rate <> 1.0")))(facts.retention)
    r.model("mart_daily_summary", "marts", ("fact_events", "fact_purchases", "dim_product"), kind="incremental", tests=(partial(reconcile.unique_grain, keys=["date", "category_l1"]),))(facts.daily_summary)
    r.model("mart_category_performance", "marts", ("fact_purchases", "dim_product"), tests=(partial(reconcile.unique_grain, keys=["category_l1", "period"]), t(checks.accepted_values, "growth_rate_label", ["new_category", "no_prior_revenue", "comparable"])))(facts.category_performance)
    r.exposures |= {"sales_dashboard": ("mart_daily_summary",), "retention_dashboard": ("mart_customer_retention",), "category_dashboard": ("mart_category_performance",)}
    return r
