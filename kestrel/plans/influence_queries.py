"""Influence-report queries (flagship) and their SQL oracles.

The oracle SQL is deliberately the brute-force form: a range join of every
window against every fact row / (store, day) cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators import influence as inf
from ..sources import derived
from .registry import register

# The (lead_days, gap_days) pairs of the checked report.
PARAMS = [(90, 0), (90, 7)]


def facts_of(spark, sf_dir):
    """L1 cleaning of the derived store-day table (coerce, revenue >= 10,
    first row per store-day)."""
    return clean.clean_store_days(derived.store_days(spark, sf_dir), order_by=["store", "business_day"])


def stats_of(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    events = derived.competitor_events(spark, sf_dir)
    return inf.scope_stats(facts, events, PARAMS)


# ----------------------------------------------------------------- SQL side
_FACTS = f"(SELECT * FROM ({derived.STORE_DAYS_SQL}) WHERE revenue >= 10)"
_EVENTS = f"({derived.COMPETITOR_EVENTS_SQL})"
_PAR = "(SELECT * FROM (VALUES " + ", ".join(f"({d}, {t})" for d, t in PARAMS) + ") AS t(lead_days, gap_days))"
_WINDOWS = f"""(
  SELECT event_id, store, lead_days, gap_days, 'before' AS period,
         CAST(open_date - (gap_days + lead_days) AS DATE) AS start_day, CAST(open_date - gap_days AS DATE) AS end_day
  FROM {_EVENTS} e, {_PAR} p WHERE has_competitor = 'Y'
  UNION ALL
  SELECT event_id, store, lead_days, gap_days, 'after',
         CAST(open_date + gap_days AS DATE), CAST(open_date + (gap_days + lead_days) AS DATE)
  FROM {_EVENTS} e, {_PAR} p WHERE has_competitor = 'Y'
  UNION ALL
  SELECT event_id, store, lead_days, gap_days, 'yago',
         CAST(open_date + (gap_days - 365) AS DATE), CAST(open_date + (gap_days + lead_days - 365) AS DATE)
  FROM {_EVENTS} e, {_PAR} p WHERE has_competitor = 'Y')"""
_KEY = "event_id, lead_days, gap_days, period"
_M8 = list(inf.REPORT_METRICS)


def _ratio_sql(empty: str) -> str:
    def guard(e):
        return f"CASE WHEN {empty} THEN NULL ELSE CAST({e} AS DOUBLE) END"

    def ratio(n, d):
        return guard(f"CASE WHEN {d} > 0 THEN {n} / {d} ELSE 0.0 END")
    return ", ".join([
        f"{guard('r')} AS avg_revenue", f"{guard('t')} AS avg_tickets",
        f"{ratio('r', 't')} AS rev_per_ticket", f"{guard('ms')} AS avg_member_sales",
        f"{guard('mt')} AS avg_member_tickets", f"{ratio('ms', 'mt')} AS member_rev_per_ticket",
        f"{ratio('ms', 'r')} AS member_sales_share", f"{ratio('mt', 't')} AS member_ticket_share"])


_OWN_SQL = f"""
  SELECT {_KEY}, days, {_ratio_sql('days = 0')} FROM (
    SELECT w.event_id, w.lead_days, w.gap_days, w.period, count(f.store) AS days,
           avg(f.revenue) AS r, avg(f.tickets) AS t, avg(f.member_sales) AS ms, avg(f.member_tickets) AS mt
    FROM {_WINDOWS} w LEFT JOIN {_FACTS} f
      ON f.store = w.store AND f.business_day >= w.start_day AND f.business_day < w.end_day
    GROUP BY w.event_id, w.lead_days, w.gap_days, w.period)"""


def _pooled_sql(where: str) -> str:
    return f"""
  SELECT {_KEY}, n_cells, {_ratio_sql('n_cells = 0')} FROM (
    SELECT w.event_id, w.lead_days, w.gap_days, w.period, count(c.store) AS n_cells,
           avg(c.revenue) AS r, avg(c.tickets) AS t, avg(c.member_sales) AS ms, avg(c.member_tickets) AS mt
    FROM {_WINDOWS} w LEFT JOIN (
        SELECT store, business_day, sum(coalesce(revenue, 0)) AS revenue, sum(coalesce(tickets, 0)) AS tickets,
               sum(coalesce(member_sales, 0)) AS member_sales, sum(coalesce(member_tickets, 0)) AS member_tickets
        FROM {_FACTS} WHERE store IS NOT NULL {where} GROUP BY store, business_day) c
      ON c.business_day >= w.start_day AND c.business_day < w.end_day
    GROUP BY w.event_id, w.lead_days, w.gap_days, w.period)"""


_ALL_SQL = _pooled_sql("")
_CONTROL_SQL = _pooled_sql(f"AND store IN (SELECT store FROM {_EVENTS} WHERE has_competitor = 'N')")

_SCOPES_SQL = " UNION ALL ".join(
    f"SELECT {_KEY}, '{s}' AS scope, {', '.join(_M8)} FROM ({q})"
    for s, q in (("own", _OWN_SQL), ("all", _ALL_SQL), ("control", _CONTROL_SQL)))

_CHANGE_SQL = " UNION ALL ".join(f"""
  SELECT a.event_id, a.lead_days, a.gap_days, a.scope, '{m}' AS metric,
         CASE WHEN b.{m} > 0 THEN a.{m} / b.{m} - 1 END AS chg_before,
         CASE WHEN y.{m} > 0 THEN a.{m} / y.{m} - 1 END AS chg_yago
  FROM S a JOIN S b ON a.event_id = b.event_id AND a.lead_days = b.lead_days AND a.gap_days = b.gap_days
                    AND a.scope = b.scope AND b.period = 'before'
           JOIN S y ON a.event_id = y.event_id AND a.lead_days = y.lead_days AND a.gap_days = y.gap_days
                    AND a.scope = y.scope AND y.period = 'yago'
  WHERE a.period = 'after'""" for m in inf.CHANGE_METRICS)
_CHANGE_SQL = f"WITH S AS ({_SCOPES_SQL}) {_CHANGE_SQL}"

_DIFF_COLS = [f"diff_own_{s}_chg_{b}" for b in inf.BASES for s in ("all", "control")]
_DIFF_SQL = f"""
  SELECT event_id, lead_days, gap_days, metric, {", ".join(
      f"max(CASE WHEN scope = 'own' THEN chg_{b} END) - max(CASE WHEN scope = '{s}' THEN chg_{b} END) AS diff_own_{s}_chg_{b}"
      for b in inf.BASES for s in ("all", "control"))}
  FROM ({_CHANGE_SQL}) GROUP BY event_id, lead_days, gap_days, metric"""


@register("influence_windows", sql=f"SELECT * FROM {_WINDOWS}")
def influence_windows(spark, sf_dir):
    """Before / after / year-ago windows per event x (D, T)."""
    return inf.event_windows(derived.competitor_events(spark, sf_dir), PARAMS)


@register("influence_own", sql=_OWN_SQL, round_cols=_M8)
def influence_own(spark, sf_dir):
    """J1 + A4 + A6: own-store interval join and window metrics."""
    return stats_of(spark, sf_dir)["own"]


@register("influence_all_stores", sql=_ALL_SQL, round_cols=_M8)
def influence_all_stores(spark, sf_dir):
    """J3 + A5 + A6: all-store cell means per window (prefix sums)."""
    return stats_of(spark, sf_dir)["all"]


@register("influence_control", sql=_CONTROL_SQL, round_cols=_M8)
def influence_control(spark, sf_dir):
    """Control-store cell means per window."""
    return stats_of(spark, sf_dir)["control"]


@register("influence_change", sql=_CHANGE_SQL, round_cols=["chg_before", "chg_yago"])
def influence_change(spark, sf_dir):
    """Period-over-period and year-ago changes per scope and metric."""
    return inf.changes(stats_of(spark, sf_dir))


@register("influence_diff", sql=_DIFF_SQL, round_cols=_DIFF_COLS)
def influence_diff(spark, sf_dir):
    """Own change minus all-store / control change."""
    return inf.change_diffs(inf.changes(stats_of(spark, sf_dir)))


def influence_report_df(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    events = derived.competitor_events(spark, sf_dir)
    return inf.influence_report(facts, events, PARAMS)


@register("influence_report")
def influence_report(spark, sf_dir):
    """L2: the wide report (one row per competing event x (D, T))."""
    return influence_report_df(spark, sf_dir)


@register("influence_report_formatted")
def influence_report_formatted(spark, sf_dir):
    """the display form of the report."""
    return inf.format_report(influence_report_df(spark, sf_dir))
