import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelscope.operators import clusters, models, selection
from panelscope.operators.splits import split_3way, split_4way
from panelscope.schema import NUMERIC_PREDICTORS, POST_EVENT_COLUMNS, PREDICTORS
from panelscope.sources.model_store import load_model, save_model
from panelscope.streaming.scoring import read_panel_stream, write_scores

SMALL = {"numTrees": 5, "maxDepth": 3}


@pytest.fixture(scope="module")
def parts(featured):
    return split_4way(featured, train_end=1998, cal_end=1999, val_end=2000)


@pytest.fixture(scope="module")
def package(parts):
    train, cal, val, _ = parts
    base = models.fit_classifier(train, "random_forest", **SMALL)
    pipeline, method, errors = models.calibrate_best(base, cal, val)
    assert errors[method] == min(errors.values())
    return models.ModelPackage(pipeline, 0.2, tuple(PREDICTORS), method)


def test_a_fit_computes_its_features_once(spark, parts, monkeypatch):
    train, _, _, test = parts
    plans, plain = [], models.classifier

    def seen(*args, **kwargs):
        model = plain(*args, **kwargs)
        fit = model.fit
        model.fit = lambda rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), fit(rows))[1]
        return model

    monkeypatch.setattr(models, "classifier", seen)
    model = models.fit_classifier(train, "random_forest", **SMALL)
    assert len(plans) == 1 and "InMemoryTableScan" in plans[0]
    assert not spark._jsc.getPersistentRDDs()
    rows = models.with_class_weight(train.select(*PREDICTORS, F.col(models.TARGET).cast("double").alias(models.TARGET)))
    rows = models.durable(rows)
    whole = Pipeline(stages=[*models.feature_pipeline(rows), plain("random_forest", **SMALL)]).fit(rows)
    a = models.score(model, test, "a").select("Record_ID", "a")
    assert a.join(models.score(whole, test, "b").select("Record_ID", "b"), "Record_ID").where("a <> b").count() == 0


def test_calibration_scores_each_part_once(parts, monkeypatch):
    train, cal, val, _ = parts
    base = models.fit_classifier(train, "random_forest", **SMALL)
    calls, plain = [], models.score
    monkeypatch.setattr(models, "score", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    pipeline, method, errors = models.calibrate_best(base, cal, val)
    assert len(calls) == 2
    *same, hist = models.calibrate_with_scores(base, cal, val)
    assert same[1:] == [method, errors]
    whole = models.metrics.score_histogram(plain(pipeline, val, method=method).select(models.TARGET, "p"), models.TARGET)
    assert sorted(hist.collect()) == sorted(whole.collect())


def test_importance_scores_variants_in_arrays(spark, parts, monkeypatch):
    """The same areas as a row per variant; only the baseline goes through the pipeline as scored rows."""
    train, _, val, _ = parts
    model = models.fit_classifier(train, "random_forest", numTrees=7, maxDepth=4)
    holes = val.withColumn("Region", F.when(F.col("Month") == 3, F.lit("elsewhere")).otherwise(F.col("Region")))
    holes = holes.withColumn("Soil_Moisture", F.when(F.col("Month") == 5, F.lit(None)).otherwise(F.col("Soil_Moisture")))
    rows = holes.select("Record_ID", models.TARGET, *PREDICTORS)
    one = holes.orderBy("Record_ID").limit(1).select(F.lit(None).cast("string").alias("Record_ID"), models.TARGET, *PREDICTORS)
    rows = rows.unionByName(holes.where("Month = 2").select(*rows.columns)).unionByName(one).unionByName(one)
    calls, plain = [], models.score
    monkeypatch.setattr(models, "score", lambda *a, **k: (calls.append(a), plain(*a, **k))[1])
    found = models.permutation_importance(model, rows, "Record_ID", PREDICTORS, n_repeats=3).collect()
    assert len(calls) == 1
    with monkeypatch.context() as m:
        m.setattr(models, "forest_ballot", lambda *a: None)
        by = {r.feature: r for r in models.permutation_importance(model, rows, "Record_ID", PREDICTORS, n_repeats=3).collect()}
    assert {r.feature for r in found} == set(PREDICTORS) == set(by) and len(found) == len(PREDICTORS)
    for r in found:
        assert r.n_repeats == by[r.feature].n_repeats == 3
        assert r.importance_mean == pytest.approx(by[r.feature].importance_mean, abs=1e-12)
        assert r.importance_std == pytest.approx(by[r.feature].importance_std, abs=1e-12)
    assert models.forest_ballot(models.fit_classifier(train, "logistic_regression", maxIter=2), PREDICTORS) is None


def test_holdout_rows_meet_the_units_once(spark, featured, monkeypatch):
    small = ["Rainfall_Anomaly", "Poverty_Rate"]
    odd = featured.where("Month = 1").withColumn("District", F.lit(None).cast("string"))  # in no unit: always trained on
    rows = models.durable(featured.unionByName(odd).select("District", models.TARGET, *small, "Season").coalesce(1))
    trained, plain = [], models.fit_classifier
    monkeypatch.setattr(models, "fit_classifier", lambda t, *a, **k: (trained.append(t), plain(t, *a, **k))[1])
    found = models.group_holdout(rows, numeric=small, categorical=["Season"], n_repeats=2, **SMALL).collect()
    assert len(found) == 2 and not any("Join" in t._jdf.queryExecution().executedPlan().toString() for t in trained)
    usable = rows.where(F.col(models.TARGET).isNotNull())
    units = usable.select("District").distinct()
    for rep, train in enumerate(trained):
        held = models.holdout_units(units, "District", 0.2, rep, 42)
        columns = ["District", models.TARGET, *small, "Season"]
        left = usable.join(held, "District", "left_anti").select(*columns)
        assert sorted(map(str, train.select(*columns).collect())) == sorted(map(str, left.collect()))


def test_the_chosen_model_copies_only_its_columns(featured, monkeypatch):
    copied, plain = [], selection.durable
    monkeypatch.setattr(selection, "durable", lambda df: (copied.append(df.columns), plain(df))[1])
    rows = selection.with_roles(featured, train_end=1998, cal_end=1999, val_end=2000)
    selection.EventClassifier(kind="random_forest", settings='{"numTrees": 5, "maxDepth": 3}').fit(rows)
    assert set(copied[0]) == {"Role", models.TARGET, *PREDICTORS}


def test_no_leakage(parts):
    assert len(PREDICTORS) == 34 and not set(PREDICTORS) & set(POST_EVENT_COLUMNS)
    with pytest.raises(ValueError, match="Economic_Loss_Million"):
        models.check_predictors(["Poverty_Rate", "Economic_Loss_Million"])
    years = [{r[0] for r in p.select("Year").distinct().collect()} for p in parts]
    assert max(years[0]) <= 1998 and years[1] == {1999} and years[2] == {2000} and min(years[3]) > 2000


def test_splits_drop_missing_targets(featured):
    kept = sum(p.count() for p in split_3way(featured, train_end=1998, val_end=2000))
    assert kept == featured.where("Disaster_Next_Month IS NOT NULL").count()
    everything = sum(p.count() for p in split_3way(featured, None, train_end=1998, val_end=2000))
    assert everything == featured.count()


def test_features_handle_unknown_and_missing(spark, parts):
    train, _, _, test = parts
    model = Pipeline(stages=models.feature_pipeline(train, ["Poverty_Rate"], ["Region"])).fit(train)
    odd = test.limit(1).withColumn("Region", F.lit("Nowhere")).withColumn("Poverty_Rate", F.lit(None).cast("double"))
    x = model.transform(odd).select(vector_to_array("features").alias("x")).first()["x"]
    assert x[1:] == [0.0] * (len(x) - 1)
    names = models.feature_names(model, ["Poverty_Rate"], ["Region"])
    assert len(names) == len(x)
    blank = test.limit(1).withColumn("Region", F.lit(None).cast("string"))
    filled = model.transform(blank).select(vector_to_array("features").alias("x")).first()["x"]
    assert sum(filled[1:]) == 1.0


def test_saved_model_scores_equal(spark, package, parts, tmp_path):
    test = parts[3]
    save_model(spark, package, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert (loaded.threshold, loaded.features, loaded.method) == (package.threshold, package.features, package.method)
    a = models.score_batch(test, package).orderBy("Record_ID").collect()
    b = models.score_batch(test, loaded).orderBy("Record_ID").collect()
    assert a == b


def test_scoring_contract(package, parts):
    out = models.score_batch(parts[3], package, threshold=0.33)
    assert out.columns == [
        "Record_ID", "District", "Year", "Month", "Predicted_Disaster_Probability",
        "Predicted_Disaster_Next_Month", "Decision_Threshold_Used",
    ]
    row = out.agg(
        F.min("Predicted_Disaster_Probability"), F.max("Predicted_Disaster_Probability"),
        F.min("Decision_Threshold_Used"), F.count_if(~F.col("Predicted_Disaster_Next_Month").isin(0, 1)),
    ).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] == 0.33 and row[3] == 0
    with pytest.raises(ValueError, match="Poverty_Rate"):
        models.score_batch(parts[3].drop("Poverty_Rate"), package)
    with pytest.raises(ValueError, match="Record_ID"):
        models.score_batch(parts[3].drop("Record_ID"), package)


def test_stream_scores_equal_batch(spark, package, parts, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = parts[3].select("Record_ID", "District", "Year", "Month", *PREDICTORS)
    rows.repartition(3).write.parquet(source)
    stream = read_panel_stream(spark, source, rows.schema, 1)
    query = write_scores(stream, package, out, str(tmp_path / "ck"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(out).orderBy("Record_ID").collect()
    assert streamed == models.score_batch(rows, package).orderBy("Record_ID").collect()


def test_ridge_penalty_matches_closed_form(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=120)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = models.ridge("label", models._ridge_penalty(df, "label", 1.0)).fit(data)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-9)


def test_calibrators_are_monotone(spark):
    rows = [(int(i % 10 < i // 100), round(i / 1000, 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "y int, p double")
    for fit in (models.calibrate_platt, models.calibrate_isotonic):
        out = models.apply_calibration(df, fit(df, "y")).orderBy("p").toPandas()["p_calibrated"]
        assert out.is_monotonic_increasing and out.between(0, 1).all()


def test_regressors(featured):
    events = featured.where("Disaster_Occurred = 1")
    for kind in ("ridge", "gamma"):
        model = models.fit_regressor(events, "Economic_Loss_Million", kind, NUMERIC_PREDICTORS[:4], ["Season"])
        row = models.predict_loss(model, events, kind).agg(F.count("y_hat"), F.min("y_hat")).first()
        assert row[0] == events.count() and row[1] > -1
    with pytest.raises(ValueError):
        models.fit_regressor(events, "Economic_Loss_Million", "no_such_model", NUMERIC_PREDICTORS[:2], [])


def test_folds_expand_by_period(featured):
    folds = models.expanding_folds(featured, "Event_Date", 3)
    for train, test in folds:
        assert train.agg(F.max("Event_Date")).first()[0] < test.agg(F.min("Event_Date")).first()[0]
    assert folds[0][0].count() < folds[1][0].count() < folds[2][0].count()


def test_attribution_sums_to_the_score(spark, parts):
    """Mean contributions reproduce p minus the root value for one row."""
    train, _, _, test = parts
    model = models.fit_classifier(train, "random_forest", ["Rainfall_Anomaly", "Poverty_Rate"], ["Season"], **SMALL)
    names = models.feature_names(model, ["Rainfall_Anomaly", "Poverty_Rate"], ["Season"])
    out = models.attribution_topk(model, test, names, k=len(names))
    assert out.count() == len(names) and out.agg(F.min("mean_abs_contribution")).first()[0] >= 0


def test_clusters(spark):
    rows = [(f"u{i}", float(i % 2) * 10 + i * 0.01, float(i % 2) * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "u string, a double, b double")
    labelled = clusters.kmeans_units(df, "u", ["a", "b"], k=2, restarts=2)
    sizes = {r["Cluster"]: r["count"] for r in labelled.groupBy("Cluster").count().collect()}
    assert sizes == {0: 30, 1: 30}
    exact = clusters.silhouette(labelled, "u", "Cluster", ["a", "b"], block_rows=16).first()["silhouette"]
    assert exact == pytest.approx(clusters.silhouette(labelled, "u", "Cluster", ["a", "b"]).first()["silhouette"]) and exact > 0.9
    assert clusters.squared_silhouette(labelled, "Cluster", ["a", "b"]).first()["silhouette"] > 0.9
    assert clusters.davies_bouldin(labelled, "Cluster", ["a", "b"]).first()["davies_bouldin"] < 0.1
    pcs = clusters.pca_2d(df, "u", ["a", "b"])
    assert pcs.columns == ["u", "PCA_1", "PCA_2"] and pcs.count() == 60


def test_all_kmeans_fits_together(spark, ranges):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    towns = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0], [9.0, 9.0]])
    x = np.vstack([t + rng.normal(size=(n, 2)) for t, n in zip(towns, (300, 20, 20, 60))])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "u long, x array<double>").repartition(5, "u").select("u", array_to_vector("x").alias("features"))
    fitted = clusters.kmeans_all(df, "u", [2, 4, 5], restarts=6)
    again = clusters.kmeans_all(df.repartition(2), "u", [2, 4, 5], restarts=6)
    for k, (centres, cost) in fitted.items():
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert len(centres) == k and cost == pytest.approx(d.min(axis=1).sum())
        assert np.allclose(centres, [x[own == c].mean(axis=0) for c in range(k)], atol=1e-6)  # settled
        assert np.allclose(centres, again[k][0]) and cost == pytest.approx(again[k][1])
        labels = clusters.with_clusters(df, fitted, {k: "c"}).orderBy("u").toPandas()["c"].to_numpy()
        assert (labels == own).all()
    assert np.abs(towns[:, None] - fitted[4][0][None]).max(axis=2).min(axis=1).max() < 0.8  # every town has a centre
    assert fitted[5][1] < fitted[4][1] < fitted[2][1]
    few = clusters.kmeans_all(df.where("u < 2").unionByName(df.where("u < 2")), "u", [3], restarts=2)
    assert len(few[3][0]) == 2 and few[3][1] == 0.0
    odd = df.limit(3).withColumn("features", F.when(F.col("u") < 0, F.col("features")))
    assert len(clusters.kmeans_all(odd, "u", [2], restarts=1)[2][0]) == 0


def test_logistic_penalty_is_one_over_n(parts):
    """Weighted mean loss plus |w|^2 / (2 n): the gradient vanishes at the fit."""
    import numpy as np

    train = parts[0]
    model = models.fit_classifier(train, "logistic_regression", ["Rainfall_Anomaly", "Poverty_Rate"], [])
    rows = models.with_class_weight(train.where("Disaster_Next_Month IS NOT NULL"))
    pdf = model.transform(rows).select(
        vector_to_array("features").alias("x"), vector_to_array("base_probability")[1].alias("p"),
        F.col("Disaster_Next_Month").alias("y"), models.WEIGHT,
    ).toPandas()
    x = np.stack(pdf["x"].to_numpy())
    beta = model.stages[-1].coefficients.toArray()
    gradient = (x * ((pdf["p"] - pdf["y"]) * pdf[models.WEIGHT]).values[:, None]).sum(0) + beta
    assert np.abs(gradient).max() < 0.05 * max(1.0, np.abs(beta).max())


def test_event_classifier_tunes_refits_and_is_saved(spark, featured, tmp_path):
    from pyspark.ml import PipelineModel

    from panelscope.operators import selection

    rows = selection.with_roles(featured, train_end=1998, cal_end=1999, val_end=2000)
    grid = '{"numTrees": [3, 5], "maxDepth": [2, 3]}'
    model = selection.EventClassifier(tune=True, grid=grid, draws=2, folds=2).fit(rows)
    table = model.tuning(spark).collect()
    best = max(table, key=lambda r: (r["mean_average_precision"], -r["setting"]))
    forest = next(s for s in model.package.pipeline.stages if hasattr(s, "trees"))
    assert len(table) == 2 and f"('numTrees', {len(forest.trees)})" in best["parameters"]
    val = rows.where("Role = 'validation'")
    scored = model.transform(val)
    assert scored.where((F.col("p") >= model.threshold) != (F.col("event") == 1)).count() == 0
    total, hit = scored.where("Disaster_Next_Month = 1").agg(F.count("*"), F.sum("event")).first()
    assert hit >= 0.75 * total
    path = str(tmp_path / "m")
    PipelineModel(stages=[model]).write().overwrite().save(path)
    again = PipelineModel.load(path).stages[0]
    assert again.threshold == model.threshold and again.table == model.table and again.getOrDefault("folds") == 2
    both = scored.select("Record_ID", "p").join(again.transform(val).select("Record_ID", F.col("p").alias("q")), "Record_ID")
    assert both.where("p != q").count() == 0


def test_comparison_and_star_use_fitted_models(featured):
    from panelscope.operators import selection
    from panelscope.plans import star

    rows = selection.with_roles(featured, train_end=1998, cal_end=1999, val_end=2000)
    fitted = {k: selection.EventClassifier(kind=k, settings=s).fit(rows) for k, s in (("random_forest", '{"numTrees": 5, "maxDepth": 3}'), ("logistic_regression", "{}"))}
    out = selection.compare_classifiers(fitted, rows.where("Role = 'validation'")).collect()
    assert len(out) == 6 and len({r["model"] for r in out if r["is_winner"]}) == 1
    by_kind = {(r["threshold_kind"], r["model"]): r for r in out}
    best = next(r["model"] for r in out if r["is_winner"])
    for name, model in fitted.items():
        assert by_kind["default", name]["threshold"] == 0.5 and by_kind["own", name]["threshold"] == model.threshold
        assert by_kind["own", name]["recall"] >= 0.75 and by_kind["winner", name]["threshold"] == fitted[best].threshold
        assert by_kind["own", name]["pr_auc"] == by_kind["default", name]["pr_auc"]
    events = featured.where("Disaster_Occurred = 1")
    table, losses = selection.compare_regressors(events.where("Year <= 1998"), events.where("Year > 1998"), "Economic_Loss_Million", {"ridge": {}, "gamma": {}})
    found = {r["model"]: r for r in table.collect()}
    assert sum(r["is_winner"] for r in found.values()) == 1 and max(found.values(), key=lambda r: r["r_squared"])["is_winner"]
    scored = selection.score_for_star(featured, fitted["random_forest"], losses["ridge"], "ridge")
    facts = star.fact_predictions(scored, star.dim_geography(featured), fitted["random_forest"].threshold).collect()
    assert len(facts) == rows.count() and {r["Decision_Threshold"] for r in facts} == {fitted["random_forest"].threshold}
    assert all((r["Predicted_Disaster_Probability"] >= r["Decision_Threshold"]) == (r["Predicted_Disaster_Class"] == 1) for r in facts)


def plain_shapley(tree, x):
    """Shapley values by all subsets of features."""
    from itertools import combinations
    from math import factorial

    def value(node, known):
        f = tree["feature"][node]
        if f < 0:
            return tree["value"][node]
        left, right = tree["left"][node], tree["right"][node]
        if f in known:
            return value(left if x[f] <= tree["threshold"][node] else right, known)
        return (tree["cover"][left] * value(left, known) + tree["cover"][right] * value(right, known)) / tree["cover"][node]

    n = len(x)
    out = [0.0] * n
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for known in combinations(others, size):
                out[i] += factorial(size) * factorial(n - size - 1) / factorial(n) * (value(0, {*known, i}) - value(0, set(known)))
    return out


def test_shapley_values_equal_all_subsets():
    import numpy as np

    rng = np.random.default_rng(7)

    def grown(depth):
        tree = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

        def visit(level, cover):
            i = len(tree["feature"])
            for k, v in zip(tree, (-1, 0.0, i, i, rng.normal(), cover)):
                tree[k].append(v)
            if level and rng.random() < 0.85:
                part = cover * rng.uniform(0.1, 0.9)
                tree["feature"][i], tree["threshold"][i] = int(rng.integers(0, 5)), rng.normal()
                tree["left"][i], tree["right"][i] = visit(level - 1, part), visit(level - 1, cover - part)
            return i

        visit(depth, 100.0)
        return {k: np.array(v) for k, v in tree.items()}

    for depth in (0, 1, 2, 4, 6):
        tree = grown(depth)
        x = rng.normal(size=(6, 5))
        out = np.zeros(x.shape)
        models.add_shapley(models.tree_paths(tree), x, out)
        assert np.allclose(out, [plain_shapley(tree, row) for row in x])


def test_shapley_values_add_up(parts):
    train, _, _, test = parts
    for kind, settings in (("random_forest", SMALL), ("gradient_boosting", {"maxIter": 3, "maxDepth": 3})):
        model = models.fit_classifier(train, kind, **settings)
        rows = test.limit(200)
        total = models.shapley_values(model, rows, "Record_ID").selectExpr("Record_ID", "base + aggregate(values, 0D, (a, b) -> a + b) AS total")
        raw = vector_to_array("base_raw")[1] if kind == "gradient_boosting" else vector_to_array("base_probability")[1]
        both = model.transform(rows).select("Record_ID", raw.alias("out")).join(total, "Record_ID").collect()
        assert len(both) == rows.count() and all(r["out"] == pytest.approx(r["total"], abs=1e-9) for r in both)
