"""Stockout-risk model and order advice F1-F11.

The model is a Spark ML pipeline (assembler -> scaler -> random forest) fit on all
complete rows (``forest``); scoring runs for every product in one ``transform`` pass.
The fitted forest is also a table, a row for each node, which scores rows without
the model: in Spark by walking it, or in any engine that reads it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schema as S
from shelfwise.functions.exprs import round_half_even, trunc_to_long
from shelfwise.operators import metrics as M
from shelfwise.operators.common import end_rows, shared
from shelfwise.operators.forest import fit_forest
from shelfwise.session import ensure_checkpoint_dir, scratch_path

FEATURES = (S.INV, S.SOLD, S.PRICE, S.DELIVERY)
SCORE = "risk_score"
CURRENT_NUMBERS = (S.OBS_DATE, S.INV, S.SOLD, S.PRICE, S.DELIVERY, S.FORECAST, M.DAYS)
CURRENT_TEXTS = (S.CATEGORY, S.STORE)
#: buckets of the hashes, by their first 16 bits
BUCKETS = 1 << 16
#: trees of a forest's table up to this size together are broadcast to the rows they score
BROADCAST_BYTES = 64 << 20


class Scaling(NamedTuple):
    """what the model's standardiser subtracts and divides by, per feature of ``FEATURES``."""
    rows: int
    mean: tuple[float, ...]
    deviation: tuple[float, ...]  # of the population


def fit_scaling(df: DataFrame) -> Scaling:
    """mean and population deviation of the features over the complete rows, from exact sums.

    Values are summed and squared as decimals of six places, so the result does not
    depend on the order of the rows; the division is done once, with fractions.
    """
    exact = {c: F.col(c).cast("decimal(18,6)") for c in FEATURES}
    one = df.select(*FEATURES).dropna().agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(exact[c]).alias(f"s_{c}") for c in FEATURES],
        *[F.sum(exact[c] * exact[c]).alias(f"q_{c}") for c in FEATURES]).first()
    n = one["n"]
    if not n:
        return Scaling(0, (0.0,) * len(FEATURES), (0.0,) * len(FEATURES))
    mean = {c: Fraction(one[f"s_{c}"]) / n for c in FEATURES}
    spread = {c: Fraction(one[f"q_{c}"]) / n - mean[c] ** 2 for c in FEATURES}
    return Scaling(n, tuple(float(mean[c]) for c in FEATURES), tuple(math.sqrt(spread[c]) for c in FEATURES))


def scaler_stage(spark: SparkSession, scaling: Scaling) -> StandardScalerModel:
    """The fitted standardiser, as a pipeline stage, that has these moments."""
    vector = lambda x: _py2java(spark.sparkContext, Vectors.dense(x))
    java = spark.sparkContext._jvm.org.apache.spark.ml.feature.StandardScalerModel(
        "risk_scaler", vector(scaling.deviation), vector(scaling.mean))
    for name, value in (("withMean", True), ("withStd", True), ("inputCol", "_features_raw"), ("outputCol", "_features")):
        java.set(java.getParam(name), value)
    stage = StandardScalerModel(java)
    stage._transfer_params_from_java()
    return stage


def risk_pipeline(spark: SparkSession, scaling: Scaling, forest: RandomForestRegressionModel) -> PipelineModel:
    """F1-F3 as one model: the assembled features, the standardiser that has these moments, the forest.

    The caller leaves out or fills rows with a missing feature.
    """
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features_raw")
    return PipelineModel([assembler, scaler_stage(spark, scaling), forest])


_MODELS: list[tuple] = []
_KEPT_MODELS = 4


def training_sample(df: DataFrame, max_rows: int, seed: int = 42) -> DataFrame:
    """the complete labelled rows, or exactly ``max_rows`` of them: those with the least hashes of their key.

    The hash is the first 60 bits of the MD5 of seed, product, date, store and row
    sequence, so any layout of the table, and any engine, gives the same rows.  Rows with
    equal hashes follow their values.  The hashes are counted by their first 16 bits, the
    bucket; all rows of the buckets before the bound are in, and only its own bucket is sorted.

    Hashing is the costly part, so the table is hashed once: a plain count tells up to which
    bucket the sample should reach, those rows are held, and what follows reads them.  If
    that falls short, as many equal keys may make it, twice the buckets are taken.
    """
    key = [S.PRODUCT, S.OBS_DATE, S.STORE, S.ROW_SEQ]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    whole = df.select(*key, *FEATURES, F.col(M.RISK).cast("double").alias(M.RISK)).dropna(subset=[*FEATURES, M.RISK])
    hashed = whole.withColumn("_hex", F.substring(F.md5(text), 1, 15))
    place = F.conv("_hex", 16, 10).cast("bigint").alias("_place")
    total = whole.count()
    if total <= max_rows:
        return hashed.select(*whole.columns, place)
    reach = -(-BUCKETS * max_rows * 11 // (total * 10)) + 4
    while True:
        # as texts of equal length, hexadecimal numbers have their own order
        near = hashed if reach >= BUCKETS else hashed.where(F.col("_hex") < F.lit(f"{reach:04x}"))
        near = shared(near.select(*whole.columns, place))
        bucket = F.shiftright("_place", 44)
        sizes = sorted(tuple(r) for r in near.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        if sum(n for _, n in sizes) >= max_rows or reach >= BUCKETS:
            break
        reach *= 2
    left = max_rows
    for last, n in sizes:
        if n > left:
            break
        left -= n
    else:
        return near
    some = near.where(bucket == last).orderBy("_place", *FEATURES, M.RISK, *key).limit(left)
    return near.where(bucket < last).unionByName(some)


def training_rows(df: DataFrame, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """features and label of all complete labelled rows; a caller may ask for a sample of them."""
    if max_rows is not None:
        return training_sample(df, max_rows, seed).select(*FEATURES, M.RISK)
    return df.select(*FEATURES, F.col(M.RISK).cast("double").alias(M.RISK)).dropna()


def fit_risk_model(df: DataFrame, trees: int = 100, seed: int = 42, max_depth: int = 12,
                   max_train_rows: int | None = None, reuse: bool = True, max_bins: int = 64) -> PipelineModel:
    """Fit the risk model on all complete enriched rows (label = M2), or on a sample that the caller asks for.

    Like the dashboard, a model is trained once per session: a call with the
    same table (``sameSemantics``) and parameters returns the fitted model; the
    last few are kept.  The dashboard's trees grow without a limit; depth and bins are
    parameters here.  Every feature is considered at every split, as in the dashboard's regressor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    app = df.sparkSession.sparkContext.applicationId  # unique per running context
    asked = (app, trees, seed, max_depth, max_train_rows, max_bins)
    for known, table, model in _MODELS:
        if reuse and known == asked and table.sameSemantics(df):
            return model
    scaling = fit_scaling(df)
    moments = [(m, 1 / d if d else 0.0) for m, d in zip(scaling.mean, scaling.deviation)]  # as the standardiser computes
    columns = {"featuresCol": "_features", "labelCol": M.RISK, "predictionCol": SCORE}
    forest = fit_forest(training_rows(df, max_train_rows, seed), FEATURES, M.RISK, moments, trees, seed, max_depth, max_bins, columns)
    model = risk_pipeline(df.sparkSession, scaling, forest)
    _MODELS[:] = [*[m for m in _MODELS if m[0][0] == app], (asked, df, model)][-_KEPT_MODELS:]
    return model


def feature_scaling(df: DataFrame) -> DataFrame:
    """mean and deviation of each feature as the model's standardiser has them, and the rows they are of."""
    scaling = fit_scaling(df)
    stage = scaler_stage(df.sparkSession, scaling)
    rows = list(zip(FEATURES, stage.mean.toArray().tolist(), stage.std.toArray().tolist(), [scaling.rows] * len(FEATURES)))
    # as SQL has them: no mean of no rows
    moment = lambda c: F.when(F.col("row_count") > 0, round_half_even(F.col(c), 6)).alias(c)
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, deviation double, row_count bigint") \
        .select("feature", moment("mean"), moment("deviation"), "row_count")


def current_product_rows(df: DataFrame, which: str = "last", columns: Sequence[str] | None = None,
                         order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """the last (or first) row of every product in file order, all stores.

    ``columns`` narrows the result, and with it the scan.
    """
    wanted = columns or (*CURRENT_NUMBERS, *CURRENT_TEXTS)
    return end_rows(df, S.PRODUCT, [c for c in wanted if c not in CURRENT_TEXTS],
                    [c for c in wanted if c in CURRENT_TEXTS], which, order_cols)


def with_risk_level(df: DataFrame, high: float = 0.7, medium: float = 0.3) -> DataFrame:
    """> 0.7 High, > 0.3 Medium, else Low; none without a score."""
    s = F.col(SCORE)
    return df.withColumn("risk_level", F.when(s > high, F.lit("High"))
                         .when(s > medium, F.lit("Medium")).when(s.isNotNull(), F.lit("Low")))


def score_risk(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """predicted risk in [0, 1] and its level for each row.

    A row that lacks a feature stays, with no score and no level.
    """
    whole = F.lit(True)
    for c in FEATURES:
        whole = whole & F.col(c).isNotNull()
    filled = rows.withColumns({"_whole": whole, **{f"_own_{c}": F.col(c) for c in FEATURES},
                               **{c: F.coalesce(c, F.lit(0.0)) for c in FEATURES}})
    scored = model.transform(filled).withColumns({
        **{c: F.col(f"_own_{c}") for c in FEATURES}, SCORE: F.when(F.col("_whole"), F.col(SCORE))})
    return with_risk_level(scored).drop("_features_raw", "_features", "_whole", *[f"_own_{c}" for c in FEATURES])


def risk_scores(df: DataFrame, trees: int = 100, seed: int = 42, max_depth: int = 12,
                max_train_rows: int | None = None) -> DataFrame:
    """F1-F6 end to end: fit on the table, score every product's current row."""
    model = fit_risk_model(df, trees, seed, max_depth, max_train_rows)
    return score_risk(model, current_product_rows(df, columns=(S.OBS_DATE, *FEATURES))).select(
        S.PRODUCT, S.OBS_DATE, *FEATURES, SCORE, "risk_level")


def forest_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """the fitted forest, a row for each node: (tree, node, feature, threshold, left, right, value).

    A row goes left where its scaled feature (mean subtracted, divided by the
    deviation) is at most the threshold; a leaf has no feature, and its value is the
    tree's prediction.
    """
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.stages[-1].write().save(path)
    names = F.array(*[F.lit(c) for c in FEATURES])
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, F.get(names, n["split"]["featureIndex"])).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        n["prediction"].alias("value"))


def _walker(trees: Broadcast):
    """A step for ``mapInArrow``: adds the values of some trees to each row's sum, in the order of the trees."""
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            total = batch.column("total").to_numpy(zero_copy_only=False).copy()
            at_row = np.arange(batch.num_rows)
            for feature, threshold, child, value in trees.value:
                at = np.zeros(batch.num_rows, dtype=np.int64)
                while True:
                    down = child[2 * at + (x[feature[at], at_row] <= threshold[at])]
                    if np.array_equal(down, at):  # a leaf is its own child
                        break
                    at = down
                total += value[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(total) if c == "total" else batch.column(c) for c in batch.schema.names], schema=batch.schema)
    return run


def _tree_arrays(nodes: DataFrame, first: int, last: int) -> list[tuple]:
    """(feature, threshold, children, value) of the trees ``first`` to ``last``, a node's children side by side: right, left."""
    number = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in FEATURES]), F.col("feature")).cast("int") - 1, F.lit(-1))
    cols = nodes.where(F.col("tree").between(first, last)).select(
        F.col("tree").cast("int").alias("tree"), F.col("node").cast("int").alias("node"), number.alias("f"),
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"), F.coalesce("left", F.lit(0)).alias("left"),
        F.coalesce("right", F.lit(0)).alias("right"), "value").toArrow()
    c = {n: cols.column(n).to_numpy() for n in cols.column_names}
    order = np.lexsort((c["node"], c["tree"]))
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(c["tree"][order])) + 1):
        f, own = c["f"][rows].astype(np.int64), np.arange(len(rows))
        child = np.stack([np.where(f < 0, own, c["right"][rows]), np.where(f < 0, own, c["left"][rows])], axis=1)
        out.append((np.maximum(f, 0), c["threshold"][rows], child.ravel(), c["value"][rows]))
    return out


def walk_forest(nodes: DataFrame, scaler: StandardScalerModel, rows: DataFrame, key: str = S.PRODUCT) -> DataFrame:
    """(key, risk_score) of each row by walking the forest's table; rows without a feature have no score.

    The trees are broadcast, at most ``BROADCAST_BYTES`` of them at a time, and each row
    walks them where it lies: no row is multiplied or shuffled.
    Values are added in the order of the trees, as the model adds them.
    """
    spark = rows.sparkSession
    sizes = sorted(tuple(r) for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each tree
    slices, held = [], 0
    for tree, n in sizes:
        if not slices or held + n * 48 > BROADCAST_BYTES:
            slices.append((tree, tree))
            held = 0
        slices[-1] = (slices[-1][0], tree)
        held += n * 48
    scaled = [((F.col(c) - F.lit(m)) * F.lit(1 / d if d else 0.0)).cast("double") for c, m, d in zip(
        FEATURES, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist())]
    whole = F.lit(True)
    for c in FEATURES:
        whole = whole & F.col(c).isNotNull()
    walked = rows.select(key, whole.alias("whole"), *[F.coalesce(x, F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(scaled)],
                         F.lit(0.0).alias("total"))
    for first, last in slices:
        trees = spark.sparkContext.broadcast(_tree_arrays(nodes, first, last))
        walked = walked.mapInArrow(_walker(trees), walked.schema)
    count = float(sizes[-1][0] + 1) if sizes else None
    return walked.select(key, F.when(F.col("whole"), F.col("total") / F.lit(count).cast("double")).alias(SCORE))


def forest_nodes(df: DataFrame) -> DataFrame:
    """the forest fitted on the table, as a table."""
    return forest_table(fit_risk_model(df), df.sparkSession)


def forest_scores(df: DataFrame) -> DataFrame:
    """every product's score and level, from the forest's table alone."""
    model = fit_risk_model(df)
    rows = current_product_rows(df, columns=(S.OBS_DATE, *FEATURES))
    return with_risk_level(walk_forest(forest_table(model, df.sparkSession), model.stages[1], rows))


def training_report(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """a training sample of that size, its row sequence as text."""
    return training_sample(df, max_rows).select(
        S.PRODUCT, S.OBS_DATE, S.STORE, F.col(S.ROW_SEQ).cast("string").alias(S.ROW_SEQ), *FEATURES, M.RISK)


def risk_inputs(df: DataFrame) -> DataFrame:
    """F5 without the fitted score: the rows it scores, and whether it can."""
    rows = current_product_rows(df, columns=(S.OBS_DATE, *FEATURES))
    whole = F.lit(True)
    for c in FEATURES:
        whole = whole & F.col(c).isNotNull()
    return rows.select(S.PRODUCT, S.OBS_DATE, *FEATURES, whole.alias("scored"))


def order_recommendation(df: DataFrame, window_days: int = 7, reorder_days: int = 14,
                         order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """Order quantity, timing and reorder delta for every product.

    ``qty = int(max(0, forecast - stock))`` (missing gives 0); timing and
    expected delivery only when ``qty > 0``; delta ``days - 14`` below 14.
    """
    cur = current_product_rows(df, columns=(S.INV, S.SOLD, S.FORECAST, S.DELIVERY, M.DAYS), order_cols=order_cols)
    qty = trunc_to_long(F.greatest(F.lit(0.0), F.col(S.FORECAST) - F.col(S.INV)))
    days = trunc_to_long(F.col(M.DAYS))
    out = cur.select(S.PRODUCT, S.INV, S.SOLD, S.FORECAST, S.DELIVERY,
                     qty.alias("recommended_qty"), days.alias("days_until_stockout"))
    q, d = F.col("recommended_qty"), F.col("days_until_stockout")
    return out.select(
        S.PRODUCT, "recommended_qty", "days_until_stockout",
        F.when(q > 0, F.least(F.lit(window_days).cast("bigint"), d)).alias("order_within_days"),
        F.when(q > 0, trunc_to_long(F.col(S.DELIVERY))).alias("expected_delivery_days"),
        F.when(d < reorder_days, d - F.lit(reorder_days)).alias("reorder_delta"))


def supply_scenarios(df: DataFrame, order_cols: Sequence[str] = S.ORDER_COLS) -> DataFrame:
    """stock now vs 1-week, 2-week and 1-month supply, long form.

    Daily sales are ``int(sales)``, or 1 when sales are not positive.  The
    verdict compares stock with the three supplies (>= month Excellent,
    >= 2 weeks Good, >= 1 week Watch Out, else Order Now).
    """
    cur = current_product_rows(df, columns=(S.INV, S.SOLD), order_cols=order_cols)
    sold = F.col(S.SOLD)
    daily = F.when(sold > 0, trunc_to_long(sold)).otherwise(F.lit(1).cast("bigint"))
    wide = cur.select(
        S.PRODUCT, trunc_to_long(F.col(S.INV)).alias("current_stock"),
        (daily * 7).alias("one_week_supply"), (daily * 14).alias("two_week_supply"),
        (daily * 30).alias("one_month_supply"))
    st = F.col("current_stock")
    wide = wide.withColumn(
        "verdict",
        F.when(st.isNull(), F.lit(None).cast("string"))
         .when(st >= F.col("one_month_supply"), F.lit("Excellent"))
         .when(st >= F.col("two_week_supply"), F.lit("Good"))
         .when(st >= F.col("one_week_supply"), F.lit("Watch Out"))
         .otherwise(F.lit("Order Now")))
    return wide.unpivot(
        ids=[S.PRODUCT, "verdict"],
        values=["current_stock", "one_week_supply", "two_week_supply", "one_month_supply"],
        variableColumnName="scenario", valueColumnName="units")
