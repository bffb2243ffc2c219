"""Risk model F1-F6: determinism, range, and skill against a mean baseline."""

import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from shelfwise.operators import risk as R
from shelfwise.plans.catalog import enriched


@pytest.fixture(scope="module")
def df(spark):
    d = enriched(spark, sf_dir("0.001")).cache()
    yield d
    d.unpersist()


def test_scores_in_range_and_levels(df):
    model = R.fit_risk_model(df, trees=10)
    out = R.score_risk(model, R.current_product_rows(df)).collect()
    assert len(out) == df.select("product_id").distinct().count()
    for r in out:
        assert 0.0 <= r.risk_score <= 1.0
        want = "High" if r.risk_score > 0.7 else "Medium" if r.risk_score > 0.3 else "Low"
        assert r.risk_level == want


def test_same_seed_same_predictions(df):
    rows = R.current_product_rows(df)
    a = R.score_risk(R.fit_risk_model(df, trees=10, seed=7, reuse=False), rows) \
        .select("product_id", "risk_score")
    b = R.score_risk(R.fit_risk_model(df, trees=10, seed=7, reuse=False), rows) \
        .select("product_id", "risk_score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_beats_mean_baseline_on_holdout(df):
    train, test = df.randomSplit([0.8, 0.2], seed=1)
    model = R.fit_risk_model(train, trees=10)
    pred = model.transform(test.select(*R.FEATURES, "stockout_risk"))
    mean = train.agg(F.avg("stockout_risk")).first()[0]
    r = pred.agg(F.avg(F.abs(F.col("risk_score") - F.col("stockout_risk"))).alias("mae"),
                 F.avg(F.abs(F.lit(mean) - F.col("stockout_risk"))).alias("base")).first()
    assert r.mae < r.base


def test_order_advice_rules(df):
    for r in R.order_recommendation(df).collect():
        assert r.recommended_qty >= 0
        if r.recommended_qty > 0:
            assert r.order_within_days == min(7, r.days_until_stockout)
        else:
            assert r.order_within_days is None and r.expected_delivery_days is None
        if r.days_until_stockout < 14:
            assert r.reorder_delta == r.days_until_stockout - 14


def test_supply_scenarios_long_form(df):
    s = R.supply_scenarios(df)
    per = s.groupBy("product_id").count().select(F.min("count"), F.max("count")).first()
    assert tuple(per) == (4, 4)


def test_model_trained_once_per_session(df):
    assert R.fit_risk_model(df, trees=5) is R.fit_risk_model(df, trees=5)
    assert R.fit_risk_model(df, trees=5) is not R.fit_risk_model(df, trees=6)


def test_training_sample_is_exact_and_layout_free(df):
    n = df.dropna(subset=[*R.FEATURES, "stockout_risk"]).count()
    ids = lambda d: sorted(tuple(r) for r in d.select("product_id", "row_seq", *R.FEATURES).collect())
    for size in (0, 1, 777, n - 1, n, n + 5):
        a = ids(R.training_sample(df.repartition(3), size))
        assert len(a) == min(n, size) and a == ids(R.training_sample(df.repartition(11), size))
    small, large = ids(R.training_sample(df, 700)), ids(R.training_sample(df, 1400))
    assert set(small) < set(large)
    assert ids(R.training_sample(df, 700, seed=1)) != small
    one = df.limit(1)
    same = one.unionByName(one).unionByName(one)  # one hash for all
    assert R.training_sample(same, 2).count() == 2


def test_the_model_scales_by_population_moments(df):
    model = R.fit_risk_model(df, trees=3)
    rows = df.select(*R.FEATURES).dropna().collect()
    for k, c in enumerate(R.FEATURES):
        x = [r[c] for r in rows]
        assert model.stages[1].mean[k] == pytest.approx(statistics.fmean(x), rel=1e-12)
        assert model.stages[1].std[k] == pytest.approx(statistics.pstdev(x), rel=1e-12)
    assert R.fit_scaling(df.repartition(13)) == R.fit_scaling(df.repartition(2))
    out = model.transform(df.select(*R.FEATURES, "stockout_risk").dropna())
    x = out.select("_features", *R.FEATURES).first()
    assert [x._features[k] for k in range(4)] == pytest.approx(
        [(x[c] - model.stages[1].mean[k]) / model.stages[1].std[k] for k, c in enumerate(R.FEATURES)])


def test_one_value_and_no_rows_scale_to_zero(df):
    same = df.limit(5).withColumn("price", F.lit(3.0))
    assert R.fit_scaling(same).deviation[2] == 0.0
    assert [r["mean"] for r in R.feature_scaling(df.limit(0)).collect()] == [None] * 4


def test_forest_table_scores_as_the_model_does(df):
    model = R.fit_risk_model(df, trees=8, max_depth=6)
    rows = R.current_product_rows(df).withColumn("price", F.when(F.col("product_id") % 50 != 3, F.col("price")))
    nodes = R.forest_table(model, df.sparkSession)
    want = {r["product_id"]: r["risk_score"] for r in R.score_risk(model, rows).collect()}
    walked = R.walk_forest(nodes, model.stages[1], rows)
    assert {r["product_id"]: r["risk_score"] for r in walked.collect()} == want  # to the last bit
    assert None in want.values() and len(set(want.values())) > 20


def test_forest_table_scores_in_another_engine(df):
    model = R.fit_risk_model(df, trees=5, max_depth=6)
    rows = R.current_product_rows(df)
    db = duckdb.connect()
    db.register("nodes", R.forest_table(model, df.sparkSession).toPandas())
    db.register("current", rows.toPandas())
    scaled = ", ".join(f"(({c}) - {m!r}) * {1 / d!r} AS {c}" for c, m, d in zip(
        R.FEATURES, model.stages[1].mean.toArray().tolist(), model.stages[1].std.toArray().tolist()))
    pick = " ".join(f"WHEN '{c}' THEN {c}" for c in R.FEATURES)
    got = dict(db.execute(f"""
WITH RECURSIVE x AS (SELECT product_id, {scaled} FROM current),
walk AS (SELECT x.*, n.tree, 0::BIGINT AS here FROM x CROSS JOIN (SELECT DISTINCT tree FROM nodes) n
 UNION ALL SELECT w.* REPLACE ((CASE WHEN CASE n.feature {pick} END <= n.threshold THEN n."left" ELSE n."right" END)::BIGINT AS here)
 FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.here WHERE n.feature IS NOT NULL)
SELECT product_id, avg(n.value) FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.here
WHERE n.feature IS NULL GROUP BY product_id""").fetchall())
    want = {r["product_id"]: r["risk_score"] for r in R.score_risk(model, rows).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
