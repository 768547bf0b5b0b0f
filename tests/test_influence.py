import datetime as dt

from pyspark.sql import functions as F

from kestrel.operators import clean, influence as inf

D = dt.date


def _facts(spark):
    rows = []
    for store in (1, 2, 3):
        for k in range(40):
            day = D(2024, 1, 1) + dt.timedelta(days=k)
            rows.append((store, day, 100.0 + store * 10 + k, 10.0, 30.0, 2.0))
    return spark.createDataFrame(rows, "store long, business_day date, revenue double, tickets double, "
                                       "member_sales double, member_tickets double")


def _events(spark):
    rows = [(10, 1, "Y", "r1", "b", 1.0, D(2024, 1, 21)), (11, 1, "Y", "r2", "b", 2.0, D(2024, 1, 25)),
            (20, 2, "N", "r3", "b", 1.0, D(2024, 1, 21)), (30, 9, "Y", "r4", "b", 1.0, D(2024, 1, 21)),
            (31, 3, "Y", "r5", "b", 1.0, None)]
    return spark.createDataFrame(rows, "event_id long, store long, has_competitor string, competitor_name string, "
                                       "competitor_brand string, competitor_distance double, open_date date")


def test_one_row_per_event_not_per_store_pair(spark):
    rep = inf.influence_report(_facts(spark), _events(spark), [(5, 0)])
    ids = sorted(r[0] for r in rep.select("event_id").collect())
    assert ids == [10, 11, 30, 31]          # store 1 has two competitors → 2 rows, not 4


def test_half_open_windows_and_missing(spark):
    st = inf.scope_stats(_facts(spark), _events(spark), [(5, 0)])
    own = {(r.event_id, r.period): r for r in st["own"].collect()}
    # before = [Jan16, Jan21): 5 days; after = [Jan21, Jan26): 5 days; yago empty
    assert own[(10, "before")].days == 5 and own[(10, "after")].days == 5
    assert own[(10, "yago")].days == 0 and own[(10, "yago")].avg_revenue is None
    assert abs(own[(10, "after")].avg_revenue - (110 + sum(range(20, 25)) / 5)) < 1e-9
    assert own[(31, "before")].days == 0     # NULL open date matches nothing
    rep = {r.event_id: r for r in inf.influence_report(_facts(spark), _events(spark), [(5, 0)]).collect()}
    assert rep[30].own_after_days is None and rep[30].all_after_avg_revenue is None  # store without data


def test_pooled_equals_brute_force(spark):
    facts, events = _facts(spark), _events(spark)
    st = inf.scope_stats(facts, events, [(5, 0), (7, 3)])
    wins = inf.event_windows(events, [(5, 0), (7, 3)])
    cells = facts.groupBy("store", "business_day").agg(F.sum("revenue").alias("rev"))
    brute = (wins.join(cells, (cells.business_day >= wins.start_day) & (cells.business_day < wins.end_day), "left")
             .groupBy("event_id", "lead_days", "gap_days", "period").agg(F.avg("rev").alias("b")))
    got = st["all"].join(brute, ["event_id", "lead_days", "gap_days", "period"])
    for r in got.collect():
        assert (r.avg_revenue is None and r.b is None) or abs(r.avg_revenue - r.b) < 1e-6
    ctrl = {(r.event_id, r.period): r.avg_revenue for r in st["control"].filter("lead_days = 5").collect()}
    assert abs(ctrl[(10, "after")] - (120 + sum(range(20, 25)) / 5)) < 1e-9   # store 2 only


def test_store_day_cleaning_keeps_first(spark):
    raw = spark.createDataFrame([("s", D(2024, 1, 1), "50", 1), ("s", D(2024, 1, 1), "70", 2),
                                 ("s", D(2024, 1, 2), "9.99", 3), ("s", D(2024, 1, 3), "abc", 4)],
                                "store string, business_day date, revenue string, ord int")
    out = clean.clean_store_days(raw, order_by=["ord"]).collect()
    assert [(r.business_day, r.revenue) for r in out] == [(D(2024, 1, 1), 50.0)]


def test_change_and_format(spark):
    rep = inf.influence_report(_facts(spark), _events(spark), [(5, 0)])
    fmt = {r.event_id: r for r in inf.format_report(rep).collect()}
    assert fmt[10].own_after_days == "5.0"
    assert fmt[10].own_chg_yago_rev_per_ticket == "NA"
    assert fmt[10].own_chg_before_rev_per_ticket.endswith("%")
