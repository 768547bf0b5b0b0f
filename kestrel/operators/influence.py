"""Competitor-opening influence report.

For every competitor event and every (lead_days D, gap_days T) pair three
half-open windows are compared:

* before ``[o-T-D, o-T)``, after ``[o+T, o+T+D)``, year-ago
  ``[o+T-365, o+T+D-365)`` (o = competitor opening date),

in three scopes:

* ``own``     the event's own store, mean over its day rows (A4);
* ``all``     every store: sum per (store, day) cell, mean over cells (A5);
* ``control`` the same over stores flagged without competitor (J4).

Plan shape (no range join over the fact table for all/control):

* own: facts ⋈ windows on ``store`` with the day range as residual; the
  window table is broadcast behind a size check, otherwise shuffled on
  ``store``;
* all/control: facts → per-day partials ``(Σ metric, #cells, #rows)``, a
  table bounded by the calendar, not by the data; prefix sums over a dense
  calendar turn each window into two equi-lookups (``cum(end) -
  cum(start)``), so the cost per window is O(1) whatever D is.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

PERIODS = ("before", "after", "yago")
SCOPES = ("own", "all", "control")
BASE_METRICS = ("revenue", "tickets", "member_sales", "member_tickets")
AVG_METRICS = ("avg_revenue", "avg_tickets", "avg_member_sales", "avg_member_tickets")
RATIO_METRICS = ("rev_per_ticket", "member_rev_per_ticket", "member_sales_share", "member_ticket_share")
# display order of one scope/period block
REPORT_METRICS = ("avg_revenue", "avg_tickets", "rev_per_ticket", "avg_member_sales",
                  "avg_member_tickets", "member_rev_per_ticket", "member_sales_share",
                  "member_ticket_share")
CHANGE_METRICS = AVG_METRICS + RATIO_METRICS
BASES = ("before", "yago")
WINDOW_KEY = ["event_id", "lead_days", "gap_days", "period"]
EVENT_KEY = ["event_id", "lead_days", "gap_days"]
YEAR_DAYS = 365


def make_params(lead_days, gap_days) -> list[tuple[int, int]]:
    """Pair the D and T lists; unequal lengths are an error."""
    lead_days, gap_days = list(lead_days), list(gap_days)
    if len(lead_days) != len(gap_days):
        raise ValueError("lead_days and gap_days must have the same length")
    return [(int(d), int(t)) for d, t in zip(lead_days, gap_days)]


def event_windows(events: DataFrame, params) -> DataFrame:
    """One row per competing event x (D, T) x period.

    Only events flagged ``has_competitor = 'Y'``; the parameter pairs are
    literal structs exploded per row (no join), NULL open date → NULL
    bounds → the window matches nothing."""
    if not params:
        raise ValueError("at least one (lead_days, gap_days) pair is required")
    o = F.col("open_date")
    par = F.explode(F.array(*[F.struct(F.lit(d).alias("lead_days"), F.lit(t).alias("gap_days"))
                              for d, t in params])).alias("p")
    ev = events.filter(F.col("has_competitor") == F.lit("Y")).select("event_id", "store", o, par)
    d, t = F.col("p.lead_days"), F.col("p.gap_days")
    wins = F.explode(F.array(
        F.struct(F.lit("before").alias("period"), F.date_sub(o, t + d).alias("start_day"),
                 F.date_sub(o, t).alias("end_day")),
        F.struct(F.lit("after").alias("period"), F.date_add(o, t).alias("start_day"),
                 F.date_add(o, t + d).alias("end_day")),
        F.struct(F.lit("yago").alias("period"), F.date_add(o, t - YEAR_DAYS).alias("start_day"),
                 F.date_add(o, t + d - YEAR_DAYS).alias("end_day")),
    )).alias("w")
    return ev.select("event_id", "store", d.alias("lead_days"), t.alias("gap_days"), wins).select(
        "event_id", "store", "lead_days", "gap_days", "w.period", "w.start_day", "w.end_day")


def _ratios(avgs: dict, empty) -> list:
    """Eight report metrics from the four averages (A6): ratios are 0.0 when
    the denominator is not > 0; everything is NULL for an empty window."""
    r, t, ms, mt = (avgs[m] for m in BASE_METRICS)
    vals = {
        "avg_revenue": r, "avg_tickets": t,
        "rev_per_ticket": tx.safe_ratio(r, t),
        "avg_member_sales": ms, "avg_member_tickets": mt,
        "member_rev_per_ticket": tx.safe_ratio(ms, mt),
        "member_sales_share": tx.safe_ratio(ms, r),
        "member_ticket_share": tx.safe_ratio(mt, t),
    }
    null = F.lit(None).cast("double")
    return [F.when(empty, null).otherwise(vals[m].cast("double")).alias(m) for m in REPORT_METRICS]


def own_window_stats(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """J1 + A4: own-store rows per window; ``days`` counts rows (0 for an
    empty window, whose metrics are NULL)."""
    f = facts.filter(F.col("store").isNotNull() & F.col("business_day").isNotNull()).select(
        F.col("store").alias("f_store"), "business_day", *BASE_METRICS)
    w = windows.select(*WINDOW_KEY, "store", "start_day", "end_day")
    cond = ((f.f_store == w.store) & (f.business_day >= w.start_day) & (f.business_day < w.end_day))
    # the window table is small (events x params x 3); AQE turns this join
    # into a broadcast join from runtime sizes, otherwise it is a shuffle
    # join on store with the day range as residual
    hits = f.join(w, cond, "inner").groupBy(*WINDOW_KEY).agg(
        F.count(F.lit(1)).alias("days"), *[F.avg(m).alias(m) for m in BASE_METRICS])
    out = windows.select(*WINDOW_KEY).join(hits, WINDOW_KEY, "left")
    days = F.coalesce(F.col("days"), F.lit(0))
    return out.select(*WINDOW_KEY, days.alias("days"),
                      *_ratios({m: F.col(m) for m in BASE_METRICS}, days == 0))


def day_partials(facts: DataFrame) -> DataFrame:
    """Per business day: Σ metric over rows (missing counts as 0, so an
    all-missing cell sums to 0 as in pandas), number of (store, day) cells
    and number of rows. Size is bounded by the calendar."""
    f = facts.filter(F.col("business_day").isNotNull())
    keyed = F.col("store").isNotNull()
    return f.groupBy("business_day").agg(
        *[F.sum(F.when(keyed, F.coalesce(F.col(m), F.lit(0.0))).otherwise(F.lit(0.0))).alias(m)
          for m in BASE_METRICS],
        F.countDistinct("store").alias("n_cells"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def _calendar_cumsums(spark, partials: DataFrame, lo, hi) -> DataFrame:
    """Dense calendar ``lo .. hi+1`` with exclusive prefix sums ``cum(d) =
    Σ_{day < d}``. The calendar length is the date span, independent of the
    number of stores or rows; the running sum is a window over that short
    table. Sums run in DECIMAL(38,6) so that ``cum(end) - cum(start)`` does
    not lose the window's digits to the magnitude of the running total."""
    n = (hi - lo).days + 2
    cal = spark.range(0, n).select(F.date_add(F.lit(lo), F.col("id").cast("int")).alias("business_day"))
    cols = list(BASE_METRICS) + ["n_cells", "n_rows"]
    j = cal.join(partials, "business_day", "left")
    w = Window.orderBy("business_day").rowsBetween(Window.unboundedPreceding, -1)
    return j.select("business_day", *[
        F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,6)")).over(w),
                   F.lit(0).cast("decimal(38,6)")).alias(f"cum_{c}") for c in cols])


def window_span(windows: DataFrame):
    """First and last day any window touches (an events-only aggregate)."""
    r = windows.agg(F.min("start_day").alias("lo"), F.max("end_day").alias("hi")).first()
    return r["lo"], r["hi"]


# calendar rows (days) up to which the prefix-sum table is broadcast
CALENDAR_BROADCAST_DAYS = 1_000_000


def pooled_window_stats(facts: DataFrame, windows: DataFrame, span=None) -> DataFrame:
    """Per window, mean over (store, day) cells of the daily sums,
    from prefix sums over the calendar (two broadcast equi-joins).

    The calendar covers exactly the days the windows touch, so facts are
    filtered to that range before the per-day aggregate (pushed to the
    scan) and every window bound is a calendar day."""
    spark = facts.sparkSession
    lo, hi = span or window_span(windows)
    cols = list(BASE_METRICS) + ["n_cells", "n_rows"]
    if lo is None:
        base = windows.select(*WINDOW_KEY).withColumn("n_cells", F.lit(0).cast("long"))
        return base.select(*WINDOW_KEY, "n_cells", *_ratios({m: F.lit(None) for m in BASE_METRICS},
                                                            F.lit(True)))
    in_span = facts.filter((F.col("business_day") >= F.lit(lo)) & (F.col("business_day") <= F.lit(hi)))
    cum = _calendar_cumsums(spark, day_partials(in_span), lo, hi)
    if (hi - lo).days + 2 <= CALENDAR_BROADCAST_DAYS:
        cum = F.broadcast(cum)
    w = windows.select(*WINDOW_KEY, F.col("start_day").alias("s_day"), F.col("end_day").alias("e_day"))
    cs = cum.select(F.col("business_day").alias("s_day"), *[F.col(f"cum_{c}").alias(f"s_{c}") for c in cols])
    ce = cum.select(F.col("business_day").alias("e_day"), *[F.col(f"cum_{c}").alias(f"e_{c}") for c in cols])
    j = w.join(cs, "s_day", "left").join(ce, "e_day", "left")
    zero = F.lit(0).cast("decimal(38,6)")
    diff = {c: F.coalesce(F.col(f"e_{c}") - F.col(f"s_{c}"), zero) for c in cols}
    n_cells, n_rows = diff["n_cells"].cast("long"), diff["n_rows"].cast("long")
    avgs = {m: F.when(n_cells > 0, diff[m].cast("double") / n_cells) for m in BASE_METRICS}
    return j.select(*WINDOW_KEY, n_cells.alias("n_cells"), *_ratios(avgs, n_rows == 0))


def control_facts(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Facts of stores flagged without competitor (semi join)."""
    ctrl = events.filter(F.col("has_competitor") == F.lit("N")).select(
        F.col("store").alias("c_store")).distinct()
    return facts.join(ctrl, facts.store == ctrl.c_store, "left_semi")


def scope_stats(facts: DataFrame, events: DataFrame, params) -> dict[str, DataFrame]:
    """Own, all-store and control statistics per window. ``facts`` feeds
    three differently filtered branches (so Spark cannot reuse one
    exchange for them): it is persisted (memory and disk) and computed
    once; a lost block is recomputed from lineage."""
    facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    windows = event_windows(events, params)
    span = window_span(windows)
    return {
        "own": own_window_stats(facts, windows),
        "all": pooled_window_stats(facts, windows, span),
        "control": pooled_window_stats(control_facts(facts, events), windows, span),
    }


def window_metrics_long(stats: dict[str, DataFrame]) -> DataFrame:
    """Union of the scopes in long form ``(event, D, T, scope, period,
    metric, value)``; ``days`` is an own-scope metric."""
    parts = []
    for scope, df in stats.items():
        names = list(REPORT_METRICS) + (["days"] if scope == "own" else [])
        pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in names)
        parts.append(df.select(*WINDOW_KEY, F.lit(scope).alias("scope"),
                               F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changes(stats: dict[str, DataFrame]) -> DataFrame:
    """``after/base - 1`` where base > 0, for base in (before, yago),
    long form ``(event, D, T, scope, metric, chg_before, chg_yago)``."""
    return changes_from_long(window_metrics_long(stats))


def changes_from_long(long: DataFrame) -> DataFrame:
    long = long.filter(F.col("metric").isin(*CHANGE_METRICS))
    g = long.groupBy(*EVENT_KEY, "scope", "metric").agg(
        *[F.max(F.when(F.col("period") == p, F.col("value"))).alias(p) for p in PERIODS])
    return g.select(*EVENT_KEY, "scope", "metric", *[
        F.when(F.col(b) > 0, F.col("after") / F.col(b) - 1).alias(f"chg_{b}") for b in BASES])


def change_diffs(chg: DataFrame) -> DataFrame:
    """Own change minus all-store and minus control change."""
    out = []
    for b in BASES:
        c = f"chg_{b}"
        out += [F.max(F.when(F.col("scope") == s, F.col(c))).alias(f"{s}_{c}") for s in SCOPES]
    g = chg.groupBy(*EVENT_KEY, "metric").agg(*out)
    return g.select(*EVENT_KEY, "metric", *[
        (F.col(f"own_chg_{b}") - F.col(f"{s}_chg_{b}")).alias(f"diff_own_{s}_chg_{b}")
        for b in BASES for s in ("all", "control")])


def report_columns() -> list[str]:
    cols = ["store", "competitor_name", "competitor_brand", "competitor_distance", "open_date",
            "earliest_day", "lead_days", "gap_days"]
    for p in PERIODS:
        cols.append(f"own_{p}_days")
        for s in SCOPES:
            cols += [f"{s}_{p}_{m}" for m in REPORT_METRICS]
    for b in BASES:
        for m in CHANGE_METRICS:
            cols += [f"own_chg_{b}_{m}", f"all_chg_{b}_{m}", f"control_chg_{b}_{m}",
                     f"diff_own_all_chg_{b}_{m}", f"diff_own_control_chg_{b}_{m}"]
    return cols


def influence_report(facts: DataFrame, events: DataFrame, params) -> DataFrame:
    """L2: the wide report, one row per competing event x (D, T).

    Events of a store without any fact row get no metrics (the reference
    skips such stores). Joined to event attributes on ``event_id`` (not on
    the store name, so several competitors of one store do not fan out)
    and to the store's earliest day (J7)."""
    facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    stats = scope_stats(facts, events, params)

    def per_scope(scope: str) -> DataFrame:
        # one row per event x (D, T): the three periods side by side
        names = list(REPORT_METRICS) + (["days"] if scope == "own" else [])
        return stats[scope].groupBy(*EVENT_KEY).agg(*[
            F.max(F.when(F.col("period") == p, F.col(m))).alias(f"{scope}_{p}_{m}")
            for p in PERIODS for m in names])

    wide = per_scope("own").join(per_scope("all"), EVENT_KEY).join(per_scope("control"), EVENT_KEY)
    chg = {}
    for b in BASES:
        for m in CHANGE_METRICS:
            for s in SCOPES:
                base, after = F.col(f"{s}_{b}_{m}"), F.col(f"{s}_after_{m}")
                chg[f"{s}_chg_{b}_{m}"] = F.when(base > 0, after / base - 1)
            for s in ("all", "control"):
                chg[f"diff_own_{s}_chg_{b}_{m}"] = chg[f"own_chg_{b}_{m}"] - chg[f"{s}_chg_{b}_{m}"]
    metrics = wide.select(*EVENT_KEY, *[c for c in wide.columns if c not in EVENT_KEY],
                          *[e.alias(n) for n, e in chg.items()])

    has_data = facts.filter(F.col("store").isNotNull()).select(F.col("store").alias("d_store")).distinct()
    ev = events.filter(F.col("has_competitor") == F.lit("Y")).select(
        "event_id", "store", "competitor_name", "competitor_brand", "competitor_distance", "open_date")
    ev = ev.join(has_data, ev.store == has_data.d_store, "left").withColumn(
        "_has_data", F.col("d_store").isNotNull()).drop("d_store")
    par = F.explode(F.array(*[F.struct(F.lit(d).alias("lead_days"), F.lit(t).alias("gap_days"))
                              for d, t in params])).alias("p")
    ev = ev.select("*", par).select("*", "p.lead_days", "p.gap_days").drop("p")
    earliest = facts.filter(F.col("store").isNotNull()).groupBy(F.col("store").alias("e_store")).agg(
        F.min("business_day").alias("earliest_day"))
    out = ev.join(metrics, EVENT_KEY, "left").join(
        earliest, ev.store == earliest.e_store, "left").drop("e_store")
    metric_cols = [c for c in report_columns()[8:]]
    return out.select(
        "event_id", *report_columns()[:8],
        *[F.when(F.col("_has_data"), F.col(c)).alias(c) for c in metric_cols])


def format_report(report: DataFrame) -> DataFrame:
    """the display form. Change columns of the four ratio metrics (and
    their differences) as percent with one decimal, the other difference
    columns with three decimals, day counts with one decimal, missing →
    'NA'. Change columns of the four daily averages stay numbers (the
    reference's suffix list does not match them)."""
    exprs = []
    for c in report.columns:
        if "_chg_" in c and c.endswith(RATIO_METRICS):
            exprs.append(tx.fmt_percent(F.col(c), 1).alias(c))
        elif c.startswith("diff_"):
            exprs.append(tx.fmt_fixed(F.col(c), 3).alias(c))
        elif c.endswith("_days") and c.startswith("own_"):
            exprs.append(tx.fmt_fixed(F.col(c), 1).alias(c))
        else:
            exprs.append(F.col(c))
    return report.select(*exprs)
