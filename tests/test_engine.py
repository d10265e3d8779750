"""Operators of the learning engine against known results, and the errors they raise."""

import math

import numpy as np
import psutil
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import errors
from millrace.dataset import Dataset
from millrace.functions import cart
from millrace.operators import cluster, decomposition, feature_selection, inspection, linear, metrics, naive_bayes, neighbors, preprocessing, trees
from millrace.operators import model_selection as ms
from millrace.operators.pipeline import Pipeline
from millrace.plans.aggregates import medians
from millrace.sources import models, tables
from millrace.streaming import scoring


@pytest.fixture(scope="module")
def make(spark):
    def dataset(xs, ys=None, kind="double"):
        xs = [list(x) if isinstance(x, (list, tuple)) else [x] for x in xs]
        p = len(xs[0])
        ys = [0.0] * len(xs) if ys is None else [float(y) for y in ys] if kind == "double" else ys
        rows = [(i, *map(float, x), y) for i, (x, y) in enumerate(zip(xs, ys))]
        schema = "row_id long, " + ", ".join(f"x{j} double" for j in range(p)) + f", y {kind}"
        return Dataset(spark.createDataFrame(rows, schema), [f"x{j}" for j in range(p)], "y", "row_id")

    return dataset


def last(df):
    return [r[-1] for r in df.orderBy("row_id").collect()]


def features(data):
    return [[r[c] for c in data.features] for r in data.df.orderBy("row_id").collect()]


# --- data ------------------------------------------------------------------------------------------


def test_validation_names_the_first_cell(make):
    with pytest.raises(errors.NonFiniteFeature) as e:
        make([[1, 2], [3, math.nan], [math.inf, 1]]).validate()
    assert e.value.values == {"row": 1, "column": "x1"} and e.value.code == "NonFiniteFeature"
    with pytest.raises(errors.InfiniteFeature) as e:
        make([[1, 2], [3, math.nan], [math.inf, 1]]).validate(allow_nan=True)
    assert e.value.values == {"row": 2, "column": "x0"}
    with pytest.raises(errors.NonFiniteActualTarget):
        make([1, 2], [1, math.nan]).validate(finite_target=True)
    data = make([1.0])
    with pytest.raises(errors.EmptySamples):
        data.with_df(data.df.limit(0)).validate()
    with pytest.raises(errors.EmptyFeatures):
        Dataset(data.df, []).validate()
    assert data.shape() == (1, 1)


# --- preprocessing ---------------------------------------------------------------------------------


def test_scalers(make):
    data = make([[1, 2], [3, 2], [5, 2]])
    assert features(preprocessing.MinMaxScaler().fit(data).transform(data)) == [[0, 0], [0.5, 0], [1, 0]]
    model = preprocessing.StandardScaler().fit(data)
    assert model.scale[1] == 1 and math.isclose(model.scale[0], math.sqrt(8 / 3))
    np.testing.assert_allclose(features(model.inverse_transform(model.transform(data))), features(data))
    with pytest.raises(errors.InvalidFeatureRange):
        preprocessing.MinMaxScaler(1, 1)
    with pytest.raises(errors.MismatchedFeatureCount):
        model.transform(make([1.0]))


def test_imputer(make):
    nan = math.nan
    assert preprocessing.SimpleImputer.mean().fit(make([[1, nan], [nan, 2], [3, 4]])).fill_values == (2, 3)
    assert preprocessing.SimpleImputer.median().fit(make([[1, 10], [100, nan], [3, 30], [nan, 20]])).fill_values == (3, 20)
    data = make([[nan], [nan]])
    with pytest.raises(errors.AllValuesMissing):
        preprocessing.SimpleImputer.mean().fit(data)
    assert features(preprocessing.SimpleImputer.constant(7).fit(data).transform(data)) == [[7], [7]]
    with pytest.raises(errors.InvalidImputationConstant):
        preprocessing.SimpleImputer.constant(nan)


def test_polynomial(make):
    data = make([[2, 3]])
    assert features(preprocessing.PolynomialFeatures(2).fit(data).transform(data)) == [[1, 2, 3, 4, 6, 9]]
    assert features(preprocessing.PolynomialFeatures(2, False, True).fit(data).transform(data)) == [[2, 3, 6]]
    assert features(preprocessing.PolynomialFeatures(3, False).fit(data).transform(data)) == [[2, 3, 4, 6, 9, 8, 12, 18, 27]]
    big = make([[1e200, 1e200]])
    with pytest.raises(Exception, match="NonFinitePrediction"):
        preprocessing.PolynomialFeatures(2).fit(big).transform(big).df.collect()


def test_encoders(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "row_id long, c string")
    model = preprocessing.LabelEncoder().fit(df, "c")
    assert model.classes == ["a", "b"] and [r["code"] for r in model.transform(df, "c").orderBy("row_id").collect()] == [1, 0, 1]
    with pytest.raises(Exception, match="UnknownLabel"):
        model.transform(spark.createDataFrame([("z",)], "c string"), "c").collect()
    with pytest.raises(Exception, match="InvalidClassIndex"):
        model.inverse_transform(spark.createDataFrame([(2,)], "code int"), "code").collect()
    assert preprocessing.OneHotEncoder(True).fit(df.where("c = 'a'"), "c").transform(df.where("c = 'a'"), "c").columns == ["row_id", "c"]


def test_selection(make):
    data = make([[1, 2, 0, 5], [1, 4, 0, 3], [1, 6, 0, 1], [1, 8, 0, 8]])
    model = feature_selection.VarianceThreshold().fit(data)
    assert model.variances == (0, 5, 0, 6.6875) and model.selected == (1, 3) and model.transform(data).features == ("x1", "x3")
    labelled = make([[1, 10], [2, 9], [1.5, 11], [8, 1], [9, 2], [8.5, 0.5]], list("aaabbb"), "string")
    np.testing.assert_allclose(feature_selection.f_classif(labelled), [294, 147.8421052631579])
    np.testing.assert_allclose(feature_selection.f_regression(make([1, 2, 3, 4, 5], [2, 4, 5, 4.5, 5.5])), [10.074626865671641])
    best = feature_selection.SelectKBest(2).fit(data, lambda d: [1.0, math.nan, 3.0, 1.0])
    assert best.selected == (0, 2)


def test_pipeline_learns_in_order(make):
    nan = math.nan
    data = make([[1], [nan], [3]], [1, 2, 3])
    steps = Pipeline().then(preprocessing.SimpleImputer.mean()).then(preprocessing.StandardScaler())
    model = steps.with_estimator(linear.LinearRegression()).fit(data)
    np.testing.assert_allclose([r["prediction"] for r in model.predict(data).orderBy("row_id").collect()], [1, 2, 3])
    with pytest.raises(errors.NonFiniteFeature):
        Pipeline().fit(data)


# --- linear models ---------------------------------------------------------------------------------


def test_regressions(make):
    model = linear.LinearRegression().fit(make([[0, 0], [1, 0], [0, 2], [2, 1], [3, -1]], [3, 5, 2, 6.5, 9.5]))
    np.testing.assert_allclose([model.intercept, *model.coefficients], [3, 2, -0.5])
    np.testing.assert_allclose(linear.RidgeRegression(1, False).fit(make([1, 2, 3], [1, 2, 3])).coefficients, [14 / 15])
    data = make([[1, 0, 3], [2, 1, 0], [3, 0, 1], [4, 1, 2], [5, 0, 0], [6, 1, 4]], [3.1, 4.8, 7.05, 9, 10.9, 13.15])
    np.testing.assert_allclose(linear.LassoRegression(0.5, True, 100_000, 1e-10).fit(data).coefficients, [1.842857142857143, 0, 0], atol=1e-9)
    model = linear.ElasticNetRegression(0.5, 0.3, True, 100_000, 1e-10).fit(data)
    np.testing.assert_allclose([model.intercept, *model.coefficients], [1.8062278529887488, 1.7444518898784154, 0, 0.0529143194620789], atol=1e-9)
    with pytest.raises(errors.RankDeficientDesign) as e:
        linear.LinearRegression().fit(make([[1, 2], [2, 4], [3, 6], [4, 8]], [1, 2, 3, 4]))
    assert e.value.values == {"rank": 2, "columns": 3}
    with pytest.raises(errors.InsufficientSamples):
        linear.LinearRegression().fit(make([[1, 2], [2, 5]], [1, 2]))
    with pytest.raises(errors.OptimizationDidNotConverge):
        linear.LassoRegression(0.001, True, 1, 1e-12).fit(data)
    for bad in (lambda: linear.RidgeRegression(-1), lambda: linear.ElasticNetRegression(1, 2), lambda: linear.LogisticRegression(max_iterations=0), lambda: linear.LogisticRegression(tolerance=0)):
        with pytest.raises(errors.AnalyticsError):
            bad()


def test_classifiers(make):
    model = linear.LogisticRegression().fit(make([-1, 1], ["no", "yes"], "string"))
    np.testing.assert_allclose([model.intercept, *model.coefficients], [0, 0.6748316143423996], atol=1e-10)
    six = make([[-3, 0], [-2, 0.5], [3, 0], [2, 0.5], [0, 3], [0.5, 2]], ["amber", "amber", "blue", "blue", "cyan", "cyan"], "string")
    model = linear.MulticlassLogisticRegression().fit(six)
    np.testing.assert_allclose(last(model.predict_probabilities(make([[-2.5, 0]])))[0], [0.8572501, 0.0448056, 0.09794434], atol=1e-6)
    nine = make([[-3, 0], [-2, 0.5], [-2, -0.5], [3, 0], [2, 0.5], [2, -0.5], [0, 3], [0.5, 2], [-0.5, 2]], ["amber"] * 3 + ["blue"] * 3 + ["cyan"] * 3, "string")
    model = linear.LinearDiscriminantAnalysis().fit(nine)
    np.testing.assert_allclose(model.intercepts, [-14.462248652304474, -14.462248652304474, -15.798612288668112])
    with pytest.raises(errors.ExpectedBinaryTargets):
        linear.LogisticRegression().fit(six)
    with pytest.raises(errors.ExpectedMulticlassTargets):
        linear.MulticlassLogisticRegression().fit(make([-1, 1], ["no", "yes"], "string"))


def test_naive_bayes(make):
    model = naive_bayes.GaussianNaiveBayes().fit(make([-2, -1, -0.5, 0.5, 1, 2], ["no"] * 3 + ["yes"] * 3, "string"))
    np.testing.assert_allclose(last(model.predict_probabilities(make([-1.5])))[0][0], 0.999876605, rtol=1e-8)
    assert last(model.predict(make([0]))) == ["no"]
    counts = make([[2, 1, 0], [1, 1, 1], [0, 2, 3], [3, 0, 0], [0, 0, 4], [1, 3, 1]], list("aababb"), "string")
    model = naive_bayes.MultinomialNaiveBayes().fit(counts)
    np.testing.assert_allclose(last(model.predict_probabilities(make([[1, 1, 1], [0, 0, 5]]))), [[0.52509352, 0.47490648], [0.00308273, 0.99691727]], atol=1e-8)
    with pytest.raises(Exception, match="NegativeFeature"):
        model.predict(make([[-1, 0, 0]])).collect()
    with pytest.raises(errors.NegativeFeature):
        naive_bayes.MultinomialNaiveBayes().fit(make([[-1]], ["a"], "string"))
    bits = make([[1, 0, 1, 0], [1, 1, 0, 0], [0, 1, 1, 1], [1, 0, 0, 0], [0, 0, 1, 1], [0, 1, 1, 0]], list("aababb"), "string")
    model = naive_bayes.BernoulliNaiveBayes().fit(bits)
    np.testing.assert_allclose(last(model.predict_probabilities(make([[1, 1, 0, 0]])))[0][0], 0.94117647, atol=1e-8)


# --- trees -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("local_rows", [200_000, 3])
def test_trees_and_boosting(make, local_rows):
    step = make([[0, 0], [0, 1], [1, 0], [1, 0], [1, 1], [1, 1]], [0, 0, 5, 5, 9, 9])
    np.testing.assert_allclose(trees.DecisionTreeRegressor(local_rows=local_rows).fit(step).feature_importances, [0.80327869, 0.19672131], atol=1e-8)
    xor = make([[0, 0], [0, 1], [1, 0], [1, 1]], list("abba"), "string")
    assert last(trees.DecisionTreeClassifier(local_rows=local_rows).fit(xor).predict(xor)) == list("abba")
    ten = make(range(10), [1, 1.2, 1.5, 4.8, 5.1, 5.3, 9.9, 10.1, 10.4, 10])
    model = trees.GradientBoostingRegressor(n_estimators=20, local_rows=local_rows).fit(ten)
    np.testing.assert_allclose(last(model.predict(make([0.5, 3.5, 8.5]))), [1.6234681781199294, 4.954748573166578, 9.852274656874192])
    model = trees.GradientBoostingRegressor(2, 4, 2, local_rows, 10, 0.2).fit(ten)
    np.testing.assert_allclose(last(model.predict(make([0.5, 3.5, 8.5]))), [1.72365983, 5.02850565, 9.745056], atol=1e-6)
    eight = make([-3, -2, -1, -0.5, 0.5, 1, 2, 3], ["no"] * 4 + ["yes"] * 4, "string")
    model = trees.GradientBoostingClassifier(n_estimators=20, local_rows=local_rows).fit(eight)
    np.testing.assert_allclose(last(model.predict_probabilities(make([-0.25])))[0][0], 0.9344864, atol=1e-7)
    model = trees.AdaBoostClassifier(n_estimators=10, local_rows=local_rows).fit(eight)
    assert len(model.trees) == 1
    np.testing.assert_allclose(last(model.predict_probabilities(make([1])))[0][1], 0.88079708, atol=1e-8)
    noisy = make([-3, -2, -1, -0.5, 0.4, 0.6, 1, 1.5, 2, 3], ["no", "no", "no", "yes", "no", "yes", "yes", "no", "yes", "yes"], "string")
    model = trees.AdaBoostClassifier(n_estimators=6, local_rows=local_rows).fit(noisy)
    np.testing.assert_allclose([p[1] for p in last(model.predict_probabilities(make([-0.25, 0.25, 1.2])))], [0.61141589, 0.44575364, 0.58478936], atol=1e-8)
    with pytest.raises(errors.WeakLearnerNoBetterThanRandom):
        trees.AdaBoostClassifier(local_rows=local_rows).fit(make([1, 1], ["a", "b"], "string"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 3)), min_size=8, max_size=40), st.integers(1, 3))
def test_levels_equal_arrays(make, rows, leaf):
    data = make([r[:2] for r in rows], [r[2] for r in rows])
    one = trees.DecisionTreeRegressor(3, 2, leaf).fit(data).predict(data)
    two = trees.DecisionTreeRegressor(3, 2, leaf, local_rows=2).fit(data).predict(data)
    np.testing.assert_allclose(last(one), last(two), atol=1e-9)


def test_forests(make):
    data = make([[i % 7, i] for i in range(60)], ["a" if i < 30 else "b" for i in range(60)], "string")
    model = trees.RandomForestClassifier(n_estimators=12).fit(data)
    assert last(model.predict(data)) == last(data.df)
    assert last(trees.RandomForestClassifier(n_estimators=12).fit(data).predict_probabilities(data)) == last(model.predict_probabilities(data))
    assert model.feature_importances[1] > model.feature_importances[0]
    far = trees.RandomForestClassifier(n_estimators=3, max_depth=2, local_rows=20).fit(data)
    assert np.mean([x == y for x, y in zip(last(far.predict(data)), last(data.df))]) > 0.9
    assert [trees.features_per_split(r, 10) for r in ("all", "sqrt", "log2", 4, 40)] == [10, 3, 3, 4, 10]
    for bad in (lambda: trees.RandomForestClassifier(n_estimators=0), lambda: trees.DecisionTreeClassifier(min_samples_split=1), lambda: trees.DecisionTreeClassifier(min_samples_leaf=0), lambda: trees.RandomForestRegressor(max_features=0), lambda: trees.AdaBoostClassifier(learning_rate=0)):
        with pytest.raises(errors.AnalyticsError):
            bad()


# --- neighbours, clusters, components --------------------------------------------------------------


def test_neighbors(make):
    train = make([-3, -2, -1, 1, 2, 3], ["no"] * 3 + ["yes"] * 3, "string")
    assert last(neighbors.KNeighborsClassifier(3).fit(train).predict(make([-0.5, 0.5, 2.5]))) == ["no", "yes", "yes"]
    squares = make(range(5), [0, 1, 4, 9, 16])
    for how in ("uniform", "distance"):
        np.testing.assert_allclose(last(neighbors.KNeighborsRegressor(2, how).fit(squares).predict(make([0.5, 2.5, 3.5]))), [0.5, 6.5, 12.5])
    assert last(neighbors.KNeighborsRegressor(2, "distance").fit(squares).predict(make([3]))) == [9]
    near = [sorted(map(tuple, neighbors.nearest_neighbors(train, make([-0.5, 0]), 4, cells).collect())) for cells in (10**6, 0)]
    assert near[0] == near[1]
    with pytest.raises(errors.InsufficientSamples):
        neighbors.KNeighborsClassifier(9).fit(train)
    with pytest.raises(errors.InvalidNeighborCount):
        neighbors.KNeighborsClassifier(0)


def _worker_peak_mb(run):
    """The greatest resident memory of a Python worker while run() runs."""
    def workers():
        return [q for q in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(q.cmdline())]

    for q in workers():
        with open(f"/proc/{q.pid}/clear_refs", "w") as f:
            f.write("5")
    run()
    status = [open(f"/proc/{q.pid}/status").read() for q in workers()]
    return max(int(s.split("VmHWM:")[1].split()[0]) for s in status if "VmHWM:" in s) / 1024


@pytest.mark.parametrize("search", [
    lambda train, asked: neighbors.nearest_neighbors(train, asked, 5),
    lambda train, asked: neighbors.KNeighborsClassifier(5).fit(train).predict(asked),
    lambda train, asked: neighbors.KNeighborsRegressor(5, "distance").fit(Dataset(train.df, train.features, "y", "id")).predict(asked),
])
def test_neighbors_of_large_tables_in_little_memory(spark, search):
    """A matrix of 512 queries and all training rows has 614 MB here."""
    draws = [(F.pmod(F.hash("id", F.lit(seed)), F.lit(99991)) / 7).alias(c) for seed, c in ((1, "a"), (2, "b"))]
    train = Dataset(spark.range(150_000).select("id", *draws, F.concat(F.lit("c"), F.col("id") % 3).alias("label"), F.col("id").cast("double").alias("y")), ["a", "b"], "label", "id")
    asked = Dataset(spark.range(200_000, 202_000).select("id", *draws), ["a", "b"], None, "id")
    assert _worker_peak_mb(lambda: search(train, asked).write.format("noop").mode("overwrite").save()) < 500


@pytest.mark.parametrize("p, k", [(1, 3), (2, 7), (6, 4)])
def test_neighbors_against_all_pairs(spark, monkeypatch, p, k):
    """Copies, equal distances, queries far away, and many cells of space."""
    monkeypatch.setattr(neighbors, "BLOCK_CELLS", 60 * p)
    rng = np.random.default_rng(p)
    x = np.concatenate([rng.integers(-9, 9, (500, p)), np.repeat(rng.integers(-9, 9, (2, p)), 90, 0)]).astype(float)
    y = np.concatenate([rng.uniform(-9, 9, (60, p)), rng.integers(-9, 9, (60, p)), np.full((80, p), 40.0)])
    frames = [spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)], "row_id long, " + ", ".join(f"x{j} double" for j in range(p))) for m in (x, y)]
    train, asked = (Dataset(f, [f"x{j}" for j in range(p)], None, "row_id") for f in frames)
    d = np.sqrt(sum((y[:, j][:, None] - x[:, j]) ** 2 for j in range(p)))
    expected = [(q, r + 1, i, d[q, i]) for q in range(len(y)) for r, i in enumerate(np.lexsort((np.arange(len(x)), d[q]))[:k].tolist())]
    for cells in (10**6, 0):
        found = neighbors.nearest_neighbors(train, asked, k, cells).drop("target").orderBy("query", "rank").collect()
        assert [tuple(row) for row in found] == expected


def test_clusters(make):
    model = cluster.KMeans(2).fit(make([[-3, -3], [-2.5, -2.5], [-3.5, -2], [3, 3], [2.5, 2.5], [3.5, 2]]))
    assert sorted(model.centres) == [(-3, -2.5), (3, 2.5)] and math.isclose(model.inertia, 2)
    points = make([[1, 1], [1.2, 1.1], [0.8, 1], [5, 5], [5.1, 5.2], [5.2, 4.9], [25, 25], [1, 4]])
    found = cluster.Dbscan(0.5, 3).fit(points)
    assert [r["cluster"] for r in found.labels.orderBy("row").collect()] == [0, 0, 0, 1, 1, 1, None, None]
    assert found.n_clusters == 2 and found.n_noise_points() == 2
    half = [[-3, -3], [-2.5, -2.5], [-3.5, -2], [-2.8, -3.2], [-3.2, -2.8]]
    model = cluster.GaussianMixture(2).fit(make(half + [[-a, -b] for a, b in half]))
    assert model.iterations == 2 and math.isclose(model.log_likelihood, -1.46531246178904)
    np.testing.assert_allclose(last(model.score_samples(make([[-3, -2.8]]))), [-0.50143578], atol=1e-8)
    for bad in (lambda: cluster.KMeans(0), lambda: cluster.Dbscan(0), lambda: cluster.Dbscan(1, 0), lambda: cluster.GaussianMixture(0)):
        with pytest.raises(errors.AnalyticsError):
            bad()


def test_components(make):
    data = make([[2.5, 2.4], [0.5, 0.7], [2.2, 2.9], [1.9, 2.2], [3.1, 3.0], [2.3, 2.7], [2, 1.6], [1, 1.1], [1.5, 1.6], [1.1, 0.9]])
    model = decomposition.PrincipalComponentAnalysis().fit(data)
    np.testing.assert_allclose(model.explained_variance, [1.2840277121727839, 0.04908339893832735])
    np.testing.assert_allclose(features(model.transform(data))[0], [0.8279701862, 0.1751153070], atol=1e-9)
    np.testing.assert_allclose(features(model.inverse_transform(model.transform(data))), features(data))
    with pytest.raises(errors.TooManyComponents):
        decomposition.PrincipalComponentAnalysis(3).fit(data)


def test_wide_moments_by_kernel(make):
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 20)) + 100
    model = decomposition.PrincipalComponentAnalysis(3).fit(make(x.tolist()))
    np.testing.assert_allclose(model.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3])


# --- metrics ---------------------------------------------------------------------------------------


def test_regression_metrics(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "a double, p double")
    assert metrics.mean_squared_error(df, "a", "p") == 0.375 and metrics.mean_absolute_error(df, "a", "p") == 0.5
    assert math.isclose(metrics.r2_score(df, "a", "p"), 0.9486081370449679)
    with pytest.raises(errors.ConstantTargets):
        metrics.r2_score(df.withColumn("a", F.lit(1.0)), "a", "p")
    with pytest.raises(errors.EmptyMetricInput):
        metrics.mean_squared_error(df.limit(0), "a", "p")


def test_mean_squared_error_of_many_rows_to_its_last_digits(spark):
    """A search's ranks hang on scores that differ by 1e-14 of themselves or less."""
    errs = np.random.default_rng(3).uniform(1e5, 2e5, 400_000)
    df = spark.createDataFrame(pa.table({"y": errs}).to_pandas()).withColumn("prediction", F.lit(0.0)).coalesce(1)
    exact = math.fsum(errs * errs) / len(errs)
    assert abs(metrics.mean_squared_error(df, "y", "prediction") - exact) <= 2 * math.ulp(exact)


def test_metric_errors_name_the_first_row(spark):
    df = spark.createDataFrame([(7, 1.0, math.inf), (3, None, 0.5), (5, math.nan, 2.0), (9, 0.0, -1.0)], "id long, a double, p double")
    for kind, row, of in (
        (errors.NonFiniteActualTarget, 3, lambda: metrics.mean_squared_error(df, "a", "p", "id")),
        (errors.NonFinitePrediction, 7, lambda: metrics.r2_score(df.na.fill(1.0).replace(math.nan, 1.0, ["a"]), "a", "p", "id")),
        (errors.InvalidProbability, 5, lambda: metrics.binary_log_loss(df, "a", "p", 1.0, "id")),
        (errors.NonFiniteProbability, 7, lambda: metrics.roc_auc_score(df.where("id > 5"), "a", "p", 1.0, "id")),
        (errors.UnknownLabel, 3, lambda: metrics.multiclass_log_loss(df.select("id", "a", F.array("p", "p").alias("p")), "a", "p", [0.0, 1.0], "id")),
        (errors.InvalidProbability, 5, lambda: metrics.roc_auc_score_ovr(df.select("id", "a", F.array("p", "p").alias("p")), "a", "p", [0.0, 1.0], ["id"])),
        (errors.NonFiniteActualTarget, None, lambda: metrics.mean_absolute_error(df, "a", "p")),
    ):
        with pytest.raises(kind) as found:
            of()
        assert found.value.values["row"] == row
        assert found.value.values.get("value", 2.0) == 2.0


def test_roc_auc_of_crowded_scores(spark):
    """Scores that lie close together, with ties, against all pairs."""
    rng = np.random.default_rng(3)
    p = np.concatenate([1e-9 * rng.integers(0, 50, 300), rng.random(20)])
    hit = rng.random(320) < 0.3 + 0.4 * (p > 2e-8)
    df = spark.createDataFrame([(int(h), float(x)) for h, x in zip(hit, p)], "a int, p double").repartition(3)
    pairs = np.sign(p[hit][:, None] - p[~hit][None, :])
    assert math.isclose(metrics.roc_auc_score(df, "a", "p", 1), ((pairs + 1) / 2).mean())


@pytest.mark.parametrize("n", [4000, 4001])
def test_medians_by_rounds(spark, n):
    rng = np.random.default_rng(n)
    columns = [rng.normal(size=n) ** 9, rng.integers(0, 3, n).astype(float), np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n)), np.full(n, -2.5)]
    schema = "a double, b double, c double, d double, e double"
    df = spark.createDataFrame([(*map(float, row), None) for row in zip(*columns)], schema).repartition(3)
    for few in (10**6, 3):
        assert medians(df, [F.col(c) for c in "abcde"], few) == [*map(np.median, columns), None]


def test_classification_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 2])), "a int, p int")
    np.testing.assert_allclose([f(df, "a", "p") for f in (metrics.precision_score, metrics.recall_score, metrics.f1_score)], [7 / 18, 0.5, 13 / 30])
    df = spark.createDataFrame(list(zip([0, 0, 0, 1], [0, 0, 1, 1])), "a int, p int")
    np.testing.assert_allclose([f(df, "a", "p", "weighted") for f in (metrics.precision_score, metrics.recall_score, metrics.f1_score)], [0.875, 0.75, 23 / 30])
    assert metrics.f1_score(df, "a", "p", "micro") == 0.75
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "a string, p string")
    assert [metrics.precision_score(df, "a", "p", "macro", z) for z in (metrics.ZERO, metrics.ONE)] == [0.25, 0.75]
    with pytest.raises(errors.UndefinedClassificationMetric) as e:
        metrics.precision_score(df, "a", "p", "macro", metrics.ERROR)
    assert e.value.values["index"] == 1
    assert {tuple(r) for r in metrics.confusion_matrix(df, "a", "p").collect()} == {("a", "a", 1), ("a", "b", 0), ("b", "a", 1), ("b", "b", 0)}


def test_probability_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])), "a int, p double")
    assert math.isclose(metrics.binary_log_loss(df, "a", "p", 1), 0.47228795380917615) and metrics.roc_auc_score(df, "a", "p", 1) == 0.75
    assert metrics.roc_auc_score(df.withColumn("p", F.lit(0.3)), "a", "p", 1) == 0.5
    rows = [("a", 0.6, 0.3, 0.1), ("b", 0.2, 0.5, 0.3), ("c", 0.3, 0.3, 0.4), ("a", 0.5, 0.2, 0.3), ("b", 0.3, 0.4, 0.3), ("c", 0.2, 0.3, 0.5), ("a", 0.4, 0.4, 0.2), ("c", 0.3, 0.2, 0.5), ("b", 0.25, 0.55, 0.2), ("a", 0.55, 0.25, 0.2)]
    many = spark.createDataFrame([(r[0], list(r[1:])) for r in rows], "a string, p array<double>")
    assert math.isclose(metrics.multiclass_log_loss(many, "a", "p", list("abc")), 0.7227960543139478)
    assert math.isclose(metrics.roc_auc_score_ovr(many, "a", "p", list("abc")), 0.9920634920634921)
    for error, bad in (
        (errors.InvalidProbability, lambda: metrics.binary_log_loss(df.withColumn("p", F.lit(1.5)), "a", "p", 1)),
        (errors.PositiveLabelNotFound, lambda: metrics.roc_auc_score(df, "a", "p", 7)),
        (errors.ExpectedBinaryTargets, lambda: metrics.roc_auc_score(df.where("a = 1"), "a", "p", 1)),
        (errors.UnknownLabel, lambda: metrics.multiclass_log_loss(many, "a", "p", list("abd"))),
        (errors.MismatchedClassCount, lambda: metrics.multiclass_log_loss(many, "a", "p", list("ab"))),
    ):
        with pytest.raises(error):
            bad()


# --- model selection -------------------------------------------------------------------------------


def test_folds(make):
    data = make(range(10))
    assert last(ms.KFold(3).split(data)) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    labelled = make(range(9), list("aaaabbbbc"), "string")
    folds = last(ms.StratifiedKFold(3).split(labelled))
    assert [folds.count(k) for k in range(3)] == [3, 3, 3]
    train, test = ms.train_test_split(data, ms.SplitOptions(0.25, shuffle=False))
    assert sorted(r["row_id"] for r in test.df.collect()) == [7, 8, 9]
    for bad in (lambda: ms.SplitOptions(0), lambda: ms.KFold(1), lambda: ms.KFold(11).split(data)):
        with pytest.raises(errors.AnalyticsError):
            bad()


def test_searches_and_curves(make):
    data = make(range(12), [2.0 * i + (i % 3) for i in range(12)])
    data = data.with_df(ms.KFold(3).split(data).cache())
    found = ms.cross_validate(linear.LinearRegression(), data, metrics.mean_squared_error)
    assert found.scores == ms.cross_validate_parallel(linear.LinearRegression(), data, metrics.mean_squared_error).scores
    grid = ms.ParameterGrid().with_parameter("b", [1, 2]).with_parameter("a", [0.1])
    assert grid.combinations() == [{"a": 0.1, "b": 1}, {"a": 0.1, "b": 2}] and grid.sample_combinations(3, 1) == grid.sample_combinations(3, 1)
    search = ms.grid_search(ms.ParameterGrid().with_parameter("alpha", [1000.0, 0.1, 0.1]), lambda p: linear.RidgeRegression(p["alpha"]), data, metrics.mean_squared_error, ms.MINIMIZE)
    assert [e.rank for e in search.entries] == [1, 1, 3] and search.best.parameters == {"alpha": 0.1}
    curve = ms.learning_curve(linear.LinearRegression(), [3, 8], data, metrics.mean_squared_error)
    assert curve.test_scores.shape == (2, 3)
    with pytest.raises(errors.InsufficientSamples):
        ms.learning_curve(linear.LinearRegression(), [9], data, metrics.mean_squared_error)
    for error, bad in (
        (errors.InvalidParameterName, lambda: grid.with_parameter(" ", [1])),
        (errors.DuplicateParameter, lambda: grid.with_parameter("a", [1])),
        (errors.EmptyParameterValues, lambda: grid.with_parameter("c", [])),
        (errors.NonFiniteParameterValue, lambda: grid.with_parameter("c", [math.inf])),
        (errors.EmptyCurvePoints, lambda: ms.validation_curve([], linear.RidgeRegression, data, metrics.mean_squared_error)),
        (errors.InvalidFoldPartition, lambda: ms.cross_validate(linear.LinearRegression(), data.with_df(data.df.withColumn("fold", F.col("fold") + 1)), metrics.mean_squared_error)),
    ):
        with pytest.raises(error):
            bad()


def test_equal_candidates_share_a_rank_whatever_sums_lose(make):
    data = make(range(6), range(6))
    data = data.with_df(ms.KFold(2).split(data).cache())
    lost = iter(range(100))
    found = ms.randomized_search(ms.ParameterGrid().with_parameter("alpha", [1.0]), 3, 7, lambda p: linear.RidgeRegression(p["alpha"]), data, lambda df, y, p: 1 + next(lost) * 2.0**-52, ms.MINIMIZE)
    assert [e.rank for e in found.entries] == [1, 1, 1]


def test_permutation_importance(make):
    data = make([[i, (i * 7) % 5] for i in range(20)], [3.0 * i for i in range(20)])
    model = linear.LinearRegression().fit(data)
    found = inspection.permutation_importance(model, data, metrics.mean_squared_error, ms.MINIMIZE, 3)
    assert found.importances_mean[0] > 1 and abs(found.importances_mean[1]) < 1e-9


# --- sources, files, streams -----------------------------------------------------------------------


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,y\n 1 ,2,x\n3,4.5, z\n")
    data = tables.dataset_from_csv(spark, str(path), 2, True, "string")
    assert [tuple(r)[1:] for r in data.df.orderBy("row_id").collect()] == [(1, 2, "x"), (3, 4.5, "z")]
    for text in ("a,b\n1,2\n3\n", "a,b\n1,2\n3,4,5\n", "a,b\n1,x\n", "a,b\n"):
        path.write_text(text)
        with pytest.raises(errors.AnalyticsError):
            tables.dataset_from_csv(spark, str(path), 1)
    with pytest.raises(errors.CsvError):
        tables.dataset_from_csv(spark, str(tmp_path / "none.csv"), 0)


def test_csv_row_numbers(spark, tmp_path):
    """Numbers follow files and places in them, however many tasks read; quoted line ends are allowed if asked for."""
    for f in range(3):
        (tmp_path / f"{f}.csv").write_text("a,y\n" + "".join(f"{i},{f}\n" for i in range(100 * f, 100 * (f + 1) - 10 * f)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        data = tables.dataset_from_csv(spark, str(tmp_path), 1)
        found = [tuple(r) for r in data.df.select("row_id", "f0").orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == list(enumerate([*range(100), *range(100, 190), *range(200, 280)]))
    path = tmp_path / "quoted.csv"
    path.write_text('a,y\n1,"p\nq"\n2,r\n')
    lines = tables.dataset_from_csv(spark, str(path), 1, True, "string", multi_line=True)
    assert [tuple(r) for r in lines.df.select("row_id", "f0", "target").orderBy("row_id").collect()] == [(0, 1.0, "p\nq"), (1, 2.0, "r")]


def test_arrow(spark):
    table = pa.table({"a": pa.array([1, None], pa.int32()), "y": ["p", "q"]})
    data = tables.arrays_from_arrow(spark, table, 1)
    filled = preprocessing.SimpleImputer.mean().fit(data).transform(data)
    assert [r["a"] for r in filled.df.collect()] == [1, 1]
    for bad in (lambda: tables.arrays_from_arrow(spark, table, 5), lambda: tables.arrays_from_arrow(spark, table, 0)):
        with pytest.raises(errors.ArrowError):
            bad()


def test_model_files(make, tmp_path):
    data = make([[i, i * i] for i in range(8)], ["a"] * 4 + ["b"] * 4, "string")
    for model in (linear.LogisticRegression().fit(data), trees.RandomForestClassifier(n_estimators=2).fit(data), trees.GradientBoostingClassifier(n_estimators=2).fit(data), preprocessing.StandardScaler().fit(data)):
        models.ModelEnvelope(model).save(str(tmp_path / "m"))
        back = models.ModelEnvelope.load(str(tmp_path / "m")).into_model()
        if hasattr(model, "predict"):
            assert last(back.predict(data)) == last(model.predict(data))
        else:
            assert back == model
    with pytest.raises(errors.UnsupportedEnvelopeVersion):
        models.ModelEnvelope.from_json('{"version": 2, "model": {}}').into_model()
    with pytest.raises(errors.SerializationError):
        models.ModelEnvelope.from_bytes(b"garbage")
    with pytest.raises(errors.IoError):
        models.ModelEnvelope.load(str(tmp_path / "none"))


def test_streams(spark, make, tmp_path):
    data = make([[i] for i in range(10)], [2.0 * i for i in range(10)])
    model = linear.LinearRegression().fit(data)
    data.df.withColumn("ts", F.timestamp_seconds(F.col("row_id") * 900)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, x0 double, y double, ts timestamp").parquet(str(tmp_path / "in"))
    scored = scoring.windowed_error(scoring.score_stream(stream, model), "ts", "y")
    run = scored.writeStream.outputMode("complete").format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    rows = spark.table("scored").collect()
    assert sum(r["n"] for r in rows) == 10 and all(abs(r["mse"]) < 1e-12 for r in rows)


def test_trees_over_arrays_graft():
    x = np.arange(6.0)[:, None]
    stats = np.column_stack([np.ones(6), np.arange(6.0), np.arange(6.0) ** 2])
    top = cart.grow(x, stats, np.ones(6), "variance", cart.Limits(1))
    for leaf in (top.left[0], top.right[0]):
        rows = np.flatnonzero(top.leaves(x) == leaf)
        top.graft(leaf, cart.grow(x[rows], stats[rows], np.ones(len(rows)), "variance", cart.Limits(), depth=1))
    assert [top.value[i][0] for i in top.leaves(x)] == list(range(6))


def test_forests_draw_as_many_rows_as_there_are_at_every_size(spark):
    """Bootstraps of n draws, grown over arrays and over Spark; rows that are all alike are drawn each for itself."""
    alike = spark.range(400).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"), "id")
    for row_id in ((), ("id",), ("y", "id")):
        data = Dataset(alike, ["x"], "y", row_id)
        for local_rows in (1000, 50):
            made = trees.RandomForestRegressor(n_estimators=3, local_rows=local_rows).fit(data).trees
            means = [float(t.value[0][0]) for t in made]
            assert [t.rows[0] for t in made] == [400] * 3
            assert len(set(means)) > 1 and all(0.3 < m < 0.7 for m in means)


def test_learning_curve_takes_shares(spark):
    data = Dataset(spark.range(90).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold")), ["x"], "y", "id")
    shares = ms.learning_curve(linear.LinearRegression(), [0.5, 1.0], data, metrics.mean_squared_error)
    rows = ms.learning_curve(linear.LinearRegression(), [30, 60], data, metrics.mean_squared_error)
    assert np.allclose(shares.test_scores, rows.test_scores, atol=1e-12)


@pytest.mark.parametrize("p, eps, min_samples, seed", [(1, 0.4, 3, 1), (2, 0.9, 5, 2), (2, 0.5, 3, 3), (3, 1.3, 4, 4), (4, 2.0, 4, 5)])
def test_dbscan_against_all_pairs(spark, p, eps, min_samples, seed):
    """Crowded and thin cells, near and far, with repeated points."""
    rng = np.random.default_rng(seed)
    xs = np.concatenate([rng.normal(0, 0.3, (60, p)), rng.normal(2.2, 0.5, (50, p)), rng.uniform(-6, 6, (60, p)), np.repeat(rng.uniform(-6, 6, (4, p)), 5, 0)]).round(2)
    near = ((xs[:, None] - xs[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_samples
    expected, clusters = [None] * len(xs), 0
    for i in np.flatnonzero(core):
        if expected[i] is None:
            todo = [i]
            while todo:
                k = todo.pop()
                if expected[k] is None:
                    expected[k] = clusters
                    todo += np.flatnonzero(near[k] & core).tolist()
            clusters += 1
    for i in np.flatnonzero(~core):
        expected[i] = min((expected[k] for k in np.flatnonzero(near[i] & core)), default=None)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], "row_id long, " + ", ".join(f"x{j} double" for j in range(p)))
    found = cluster.Dbscan(eps, min_samples).fit(Dataset(df, [f"x{j}" for j in range(p)], None, "row_id"))
    assert found.n_clusters == clusters and [r["cluster"] for r in found.labels.orderBy("row").collect()] == expected


def test_dbscan_cells_linked_by_inner_points(spark):
    """Two cells whose extreme points are not neighbours, though others are."""
    xs = [(0.6, 0.6), (0.7, 0.0), (0.0, 0.7), (0.8, 0.8), (1.4, 0.72), (0.72, 1.4), (9.0, 9.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "row_id long, x0 double, x1 double")
    found = cluster.Dbscan(1.0, 3).fit(Dataset(df, ["x0", "x1"], None, "row_id"))
    assert found.n_clusters == 1 and [r["cluster"] for r in found.labels.orderBy("row").collect()] == [0] * 6 + [None]


@pytest.mark.parametrize("ids", ["id", "cast(id AS string)"])
def test_components_of_a_long_path_in_one_task(spark, monkeypatch, ids):
    """Some jobs only, however long the path; rounds of joins find the same labels."""
    n = 3000
    path = spark.range(n).select("id", F.expr(ids).alias("row"), (F.col("id") * 0.5 + F.floor(F.col("id") / 1000) * 9).alias("x"))
    data = Dataset(path, ["x"], None, "row")
    written = []
    monkeypatch.setattr(cluster, "_cut", lambda df, cut=cluster._cut: (written.append(1), cut(df))[1])
    found = cluster.Dbscan(0.6, 2).fit(data)
    assert found.n_clusters == 3 and len(written) <= 9
    monkeypatch.setattr(cluster, "TASK_EDGES", 0)
    by_rounds = cluster.Dbscan(0.6, 2).fit(data)
    assert by_rounds.n_clusters == 3 and sorted(map(tuple, found.labels.collect())) == sorted(map(tuple, by_rounds.labels.collect()))
