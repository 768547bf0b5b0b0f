from kestrel.operators import basket as bk


def test_multi_item_consequents_and_filtered_denominator(spark):
    rows = []
    for t in range(4):
        rows += [(f"t{t}", x) for x in "abc"]
    rows += [("t9", "a"), ("t10", "rare")]
    res = bk.market_basket_analysis(spark.createDataFrame(rows, "tx_id string, item string"),
                                    min_support=0.5, min_item_frequency=2)
    rules = res.rules.collect()
    assert len(rules) == 12
    assert sum(1 for r in rules if ", " not in r.consequents) == 9
    s = res.summary.first()
    assert s.n_transactions == 5       # the rare-only transaction vanished
    sup = {r.items[0]: r.support for r in res.itemsets.filter("size = 1").collect()}
    assert abs(sup["a"] - 1.0) < 1e-12 and abs(sup["b"] - 0.8) < 1e-12
    for r in rules:
        assert r.support <= min(r.antecedent_support, r.consequent_support) + 1e-12


def test_empty_input_gives_empty_tables(spark):
    res = bk.market_basket_analysis(spark.createDataFrame([("t1", "a")], "tx_id string, item string"),
                                    min_item_frequency=2)
    assert res.rules.count() == 0 and res.summary.first().n_transactions == 0
