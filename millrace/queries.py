"""Queries of the engine's operators on the test tables, and the SQL that gives the same rows.

Floats are rounded alike on both sides.  Queries without SQL have no closed form; they are tested
against known results instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset, col
from .operators import cluster, decomposition, feature_selection, inspection, linear, metrics, naive_bayes, neighbors, preprocessing, trees
from .operators import model_selection as ms
from .operators.base import shared_folder
from .operators.pipeline import Pipeline
from .sources import models, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def numbers(spark: SparkSession, **values: float) -> DataFrame:
    """One row of rounded numbers."""
    return spark.range(1).select(*[r(F.lit(float(v))).alias(k) for k, v in values.items()])


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r(col(v), digits).alias(v) for v in values])


def lines(spark, sf_dir, target: str | None = None) -> Dataset:
    return Dataset(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], target)


def parts(spark, sf_dir, target: str | None = None) -> Dataset:
    return Dataset(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], target, "p_partkey")


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
SCALED = ["l_quantity", "l_discount", "l_tax"]

# --- sources ---------------------------------------------------------------------------------------


@query("SELECT cast(p_size AS DOUBLE) AS p_size, round(p_retailprice, 4) + 0.0 AS p_retailprice, cast(p_partkey AS DOUBLE) AS target FROM part")
def csv_load(spark, sf_dir):
    path = f"{shared_folder(spark)}/part_csv"
    table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_partkey").write.mode("overwrite").csv(path, header=True)
    data = tables.dataset_from_csv(spark, path, 2)
    return data.df.select(F.col("f0").alias("p_size"), r("f1", 4).alias("p_retailprice"), "target")


@query("SELECT p_partkey, cast(nullif(p_size, 7) AS DOUBLE) AS p_size FROM part")
def arrow_load(spark, sf_dir):
    made = table(spark, sf_dir, "part").select(F.nullif("p_size", F.lit(7)).alias("p_size"), "p_partkey").toArrow()
    data = tables.arrays_from_arrow(spark, made, 1)
    return data.df.select("p_partkey", F.when(~F.isnan("p_size"), F.col("p_size")).alias("p_size"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS slope FROM lineitem")
def model_envelope(spark, sf_dir):
    data = Dataset(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    model = models.ModelEnvelope.from_bytes(models.ModelEnvelope(linear.LinearRegression().fit(data)).to_bytes()).into_model()
    return spark.range(1).select(r(F.lit(model.intercept), 4).alias("intercept"), r(F.lit(model.coefficients[0])).alias("slope"))


# --- preprocessing ---------------------------------------------------------------------------------


@query(f"SELECT {', '.join(LINE_KEYS)}, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in SCALED) + " FROM lineitem")
def standard_scaler(spark, sf_dir):
    data = lines(spark, sf_dir)
    return rounded(preprocessing.StandardScaler().fit(data).transform(data).df, LINE_KEYS, SCALED)


@query(f"SELECT {', '.join(LINE_KEYS)}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SCALED) + " FROM lineitem")
def standard_scaler_inverse(spark, sf_dir):
    data = lines(spark, sf_dir)
    model = preprocessing.StandardScaler().fit(data)
    return rounded(model.inverse_transform(model.transform(data)).df, LINE_KEYS, SCALED)


PART = ["p_size", "p_retailprice"]


@query("SELECT p_partkey, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 3 - 1, 6) + 0.0 AS {c}" for c in PART) + " FROM part")
def minmax_scaler(spark, sf_dir):
    data = parts(spark, sf_dir)
    return rounded(preprocessing.MinMaxScaler(-1, 2).fit(data).transform(data).df, ["p_partkey"], PART)


@query("SELECT p_partkey, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in PART) + " FROM part")
def minmax_scaler_inverse(spark, sf_dir):
    data = parts(spark, sf_dir)
    model = preprocessing.MinMaxScaler().fit(data)
    return rounded(model.inverse_transform(model.transform(data)).df, ["p_partkey"], PART, 4)


def _with_gaps(spark, sf_dir) -> Dataset:
    df = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.05)))
    return Dataset(df, ["l_quantity", "l_tax"])


def _imputer(how: preprocessing.SimpleImputer, fill: str, name: str):
    @query(f"SELECT {', '.join(LINE_KEYS)}, l_quantity, round(coalesce(nullif(l_tax, 0.05), {fill}), 6) + 0.0 AS l_tax FROM lineitem", name)
    def impute(spark, sf_dir):
        data = _with_gaps(spark, sf_dir)
        return how.fit(data).transform(data).df.select(*LINE_KEYS, "l_quantity", r("l_tax").alias("l_tax"))


_imputer(preprocessing.SimpleImputer.mean(), "(SELECT avg(nullif(l_tax, 0.05)) FROM lineitem)", "imputer_mean")
_imputer(preprocessing.SimpleImputer.median(), "(SELECT median(nullif(l_tax, 0.05)) FROM lineitem)", "imputer_median")
_imputer(preprocessing.SimpleImputer.constant(0.5), "0.5", "imputer_constant")


@query("SELECT o_orderkey, o_orderpriority, cast(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return preprocessing.LabelEncoder().fit(df, "o_orderpriority").transform(df, "o_orderpriority").select("o_orderkey", "o_orderpriority", "code")


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders")
def label_decode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    model = preprocessing.LabelEncoder().fit(df, "o_orderpriority")
    return model.inverse_transform(model.transform(df, "o_orderpriority"), "code").select("o_orderkey", "label")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _one_hot(drop: bool, name: str):
    @query(None, name)
    def encode(spark, sf_dir):
        df = table(spark, sf_dir, "customer")
        made = preprocessing.OneHotEncoder(drop).fit(df, "c_mktsegment").transform(df, "c_mktsegment")
        kept = [c for c in made.columns if c.startswith("is_")]
        # long form: one row a customer and class
        return made.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(c[3:]).alias("segment"), col(c).alias("value")) for c in kept])).alias("e")).select("c_custkey", "e.*")

    first = " WHERE s.c <> (SELECT min(c_mktsegment) FROM customer)" if drop else ""
    ORACLES[name] = f"SELECT c_custkey, s.c AS segment, cast(c_mktsegment = s.c AS DOUBLE) AS value FROM customer, (SELECT DISTINCT c_mktsegment AS c FROM customer) s{first}"


_one_hot(False, "one_hot")
_one_hot(True, "one_hot_drop_first")


@query("SELECT p_partkey, 1.0::DOUBLE AS a, p_size::DOUBLE AS b, round(p_retailprice, 4) AS c, (p_size * p_size)::DOUBLE AS d, round(p_size * p_retailprice, 4) AS e, round(p_retailprice * p_retailprice, 3) AS f FROM part")
def polynomial_d2(spark, sf_dir):
    data = parts(spark, sf_dir)
    made = preprocessing.PolynomialFeatures(2).fit(data).transform(data)
    digits = [0, 0, 4, 0, 4, 3]
    return made.df.select("p_partkey", *[F.round(col(c), d).alias(n) for c, n, d in zip(made.features, "abcdef", digits)])


@query("SELECT p_partkey, p_size::DOUBLE AS a, round(p_retailprice, 4) AS b, round(p_size * p_retailprice, 4) AS c FROM part")
def polynomial_interactions(spark, sf_dir):
    data = parts(spark, sf_dir)
    made = preprocessing.PolynomialFeatures(2, include_bias=False, interaction_only=True).fit(data).transform(data)
    return made.df.select("p_partkey", *[F.round(col(c), 4).alias(n) for c, n in zip(made.features, "abc")])


# --- selection -------------------------------------------------------------------------------------


def _scored(spark, model: feature_selection.FittedSelector) -> DataFrame:
    rows = [(f, float(s), j in model.selected) for j, (f, s) in enumerate(zip(model.features, model.scores))]
    return spark.createDataFrame(rows, "feature string, score double, selected boolean").withColumn("score", r("score"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) + 0.0 AS score, var_pop({c}) > 0.0007 AS selected FROM lineitem" for c in SCALED))
def variance_threshold(spark, sf_dir):
    return _scored(spark, feature_selection.VarianceThreshold(0.0007).fit(lines(spark, sf_dir)))


def _f_classif_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) + 0.0 AS score
    FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)"""


@query(" UNION ALL ".join(map(_f_classif_sql, SCALED)))
def f_classif(spark, sf_dir):
    data = lines(spark, sf_dir, "l_returnflag")
    return spark.createDataFrame(list(zip(data.features, feature_selection.f_classif(data))), "feature string, score double").withColumn("score", r("score"))


def _f_regression_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(q * (n - 2) / (1 - q), 6) + 0.0 AS score FROM (SELECT corr({c}, l_extendedprice) ** 2 AS q, count(*) AS n FROM lineitem)"


@query(" UNION ALL ".join(map(_f_regression_sql, SCALED)))
def f_regression(spark, sf_dir):
    data = lines(spark, sf_dir, "l_extendedprice")
    return spark.createDataFrame(list(zip(data.features, feature_selection.f_regression(data))), "feature string, score double").withColumn("score", r("score"))


@query(f"SELECT feature, score, rank() OVER (ORDER BY score DESC) <= 2 AS selected FROM ({' UNION ALL '.join(map(_f_regression_sql, SCALED))})")
def select_k_best(spark, sf_dir):
    return _scored(spark, feature_selection.SelectKBest(2).fit(lines(spark, sf_dir, "l_extendedprice"), feature_selection.f_regression))


# --- splits ----------------------------------------------------------------------------------------

SHUFFLED = "md5(concat_ws('-', o_orderkey::VARCHAR, '42')), o_orderkey"


def orders(spark, sf_dir, target: str | None = None) -> Dataset:
    return Dataset(table(spark, sf_dir, "orders"), ["o_totalprice"], target, "o_orderkey")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {SHUFFLED}) > count(*) OVER () - ceil(count(*) OVER () * 0.3) AS test FROM orders")
def train_test_split(spark, sf_dir):
    train, test = ms.train_test_split(orders(spark, sf_dir), ms.SplitOptions(0.3))
    return train.df.select("o_orderkey", F.lit(False).alias("test")).union(test.df.select("o_orderkey", F.lit(True)))


def _fold_sql(order: str, k: int = 4) -> str:
    return f"""SELECT o_orderkey, cast(CASE WHEN p < m * (s + 1) THEN p // (s + 1) ELSE m + (p - m * (s + 1)) // s END AS INTEGER) AS fold
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {order}) - 1 AS p, count(*) OVER () // {k} AS s, count(*) OVER () % {k} AS m FROM orders)"""


@query(_fold_sql("o_orderkey"))
def kfold(spark, sf_dir):
    return ms.KFold(4).split(orders(spark, sf_dir)).select("o_orderkey", "fold")


@query(_fold_sql(SHUFFLED))
def kfold_shuffled(spark, sf_dir):
    return ms.KFold(4, shuffle=True).split(orders(spark, sf_dir)).select("o_orderkey", "fold")


@query(f"SELECT o_orderkey, cast((row_number() OVER (ORDER BY o_orderpriority, {SHUFFLED}) - 1) % 4 AS INTEGER) AS fold FROM orders")
def stratified_kfold(spark, sf_dir):
    return ms.StratifiedKFold(4, shuffle=True).split(orders(spark, sf_dir, "o_orderpriority")).select("o_orderkey", "fold")


# --- metrics ---------------------------------------------------------------------------------------

GUESS = "l_quantity * 1000 * (1 - l_discount)"
FLAG = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.06 THEN 'N' ELSE 'R' END"
CHANCE = "0.05 + 0.9 * l_quantity / 51"


def guessed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"guess": F.expr(GUESS), "flag": F.expr(FLAG), "chance": F.expr(CHANCE)})


def _metric(name: str, fn: Callable[[DataFrame], float], sql: str):
    @query(f"SELECT round({sql}, 6) + 0.0 AS value FROM lineitem" if "FROM" not in sql else sql, name)
    def measure(spark, sf_dir):
        return numbers(spark, value=fn(guessed(spark, sf_dir)))


_metric("mean_absolute_error", lambda d: metrics.mean_absolute_error(d, "l_extendedprice", "guess"), f"avg(abs(l_extendedprice - {GUESS}))")
_metric("mean_squared_error", lambda d: metrics.mean_squared_error(d, "l_tax", "l_discount"), "avg((l_tax - l_discount) ** 2)")
_metric("root_mean_squared_error", lambda d: metrics.root_mean_squared_error(d, "l_extendedprice", "guess"), f"sqrt(avg((l_extendedprice - {GUESS}) ** 2))")
_metric("r2_score", lambda d: metrics.r2_score(d, "l_extendedprice", "guess"), f"1 - avg((l_extendedprice - {GUESS}) ** 2) / var_pop(l_extendedprice)")
_metric("accuracy_score", lambda d: metrics.accuracy_score(d, "l_returnflag", "flag"), f"avg((l_returnflag = {FLAG})::DOUBLE)")

BY_CLASS = f"""WITH g AS (SELECT l_returnflag AS a, {FLAG} AS p FROM lineitem),
c AS (SELECT DISTINCT unnest([a, p]) AS class FROM g),
m AS (SELECT class, sum((a = class AND p = class)::INT)::DOUBLE AS hits, sum((p = class)::INT)::DOUBLE AS predicted, sum((a = class)::INT) AS support FROM g, c GROUP BY class),
t AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, support, sum(hits) OVER () / sum(support) OVER () AS accuracy FROM m),
s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM t)
"""


@query(f"SELECT a.c AS actual, p.c AS predicted, (SELECT count(*) FROM lineitem WHERE l_returnflag = a.c AND {FLAG} = p.c) AS n FROM (VALUES ('A'), ('N'), ('R')) a(c), (VALUES ('A'), ('N'), ('R')) p(c)")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(guessed(spark, sf_dir), "l_returnflag", "flag")


@query(BY_CLASS + "SELECT class, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support::BIGINT AS support, round(accuracy, 6) + 0.0 AS accuracy FROM s")
def classification_report(spark, sf_dir):
    made = metrics.classification_report(guessed(spark, sf_dir), "l_returnflag", "flag")
    return made.select("class", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support", r("accuracy").alias("accuracy"))


for _what in ("precision", "recall", "f1"):
    for _how, _sql in (("macro", "avg({0})"), ("weighted", "sum({0} * support) / sum(support)"), ("micro", "max(accuracy)")):
        _metric(
            f"{_what}_{_how}",
            lambda d, w=_what, h=_how: getattr(metrics, f"{w}_score")(d, "l_returnflag", "flag", h),
            BY_CLASS + f"SELECT round({_sql.format(_what)}, 6) + 0.0 AS value FROM s",
        )

_metric("binary_log_loss", lambda d: metrics.binary_log_loss(d, "l_linestatus", "chance", "O"), f"avg(-ln(CASE WHEN l_linestatus = 'O' THEN {CHANCE} ELSE 1 - ({CHANCE}) END))")
AUC = """SELECT round((sum(CASE WHEN hit THEN k ELSE 0 END) - p * (p + 1) / 2) / (p * (n - p)), 6) + 0.0 AS value FROM (
SELECT hit, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS k, sum(hit::INT) OVER () ::DOUBLE AS p, count(*) OVER () AS n FROM (SELECT {hit} AS hit, {c} AS c FROM lineitem)) GROUP BY p, n"""
_metric("roc_auc_score", lambda d: metrics.roc_auc_score(d, "l_linestatus", "chance", "O"), AUC.format(hit="l_linestatus = 'O'", c=CHANCE))

P3 = ["0.2 + l_discount * 2", "0.5 - l_discount * 2 + l_tax", "0.3 - l_tax"]


def chances(spark, sf_dir) -> DataFrame:
    return guessed(spark, sf_dir).withColumn("p", F.array(*map(F.expr, P3)))


@query(f"SELECT round(avg(-ln(CASE l_returnflag WHEN 'A' THEN {P3[0]} WHEN 'N' THEN {P3[1]} ELSE {P3[2]} END)), 6) + 0.0 AS value FROM lineitem")
def multiclass_log_loss(spark, sf_dir):
    return numbers(spark, value=metrics.multiclass_log_loss(chances(spark, sf_dir), "l_returnflag", "p", ["A", "N", "R"]))


def _ovr_sql() -> str:
    one = [f"(SELECT (sum(CASE WHEN hit THEN k ELSE 0 END) - p * (p + 1) / 2) / (p * (n - p)) FROM (SELECT hit, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS k, sum(hit::INT) OVER () ::DOUBLE AS p, count(*) OVER () AS n FROM (SELECT l_returnflag = '{k}' AS hit, {c} AS c FROM lineitem)) GROUP BY p, n)" for k, c in zip("ANR", P3)]
    return f"SELECT round(({' + '.join(one)}) / 3, 6) + 0.0 AS value"


@query(_ovr_sql())
def roc_auc_ovr(spark, sf_dir):
    return numbers(spark, value=metrics.roc_auc_score_ovr(chances(spark, sf_dir), "l_returnflag", "p", ["A", "N", "R"]))


# --- linear models ---------------------------------------------------------------------------------

PRICE = "3 * l_quantity - 200 * l_discount + 50 * l_tax + l_extendedprice / 1000"


def priced(spark, sf_dir, features: list[str]) -> Dataset:
    return Dataset(table(spark, sf_dir, "lineitem").withColumn("y", F.expr(PRICE)), features, "y")


def _coefficients(spark, model: linear.LinearModel) -> DataFrame:
    return numbers(spark, intercept=model.intercept, **{f"w{i}": w for i, w in enumerate(model.coefficients)})


MOMENTS = f"SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM (SELECT l_quantity AS x, {PRICE} AS y FROM lineitem)"


def _one_feature(name: str, estimator, w: str):
    @query(f"SELECT round(my - w * mx, 6) + 0.0 AS intercept, round(w, 6) + 0.0 AS w0 FROM (SELECT *, {w} AS w FROM ({MOMENTS}))", name)
    def fit(spark, sf_dir):
        return _coefficients(spark, estimator.fit(priced(spark, sf_dir, ["l_quantity"])))


_one_feature("ols_1f", linear.LinearRegression(), "c / v")
_one_feature("ridge_1f", linear.RidgeRegression(1000.0), "n * c / (n * v + 1000)")
_one_feature("lasso_1f", linear.LassoRegression(5.0, tolerance=1e-12), "sign(c) * greatest(abs(c) - 5, 0) / v")
_one_feature("elastic_net_1f", linear.ElasticNetRegression(5.0, 0.4, tolerance=1e-12), "sign(c) * greatest(abs(c) - 2, 0) / (v + 3)")

TWO = f"SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb FROM (SELECT l_quantity AS a, l_discount AS b, {PRICE} AS y FROM lineitem)"


def _two_sql(extra: str) -> str:
    return f"SELECT round(my - w0 * ma - w1 * mb, 6) + 0.0 AS intercept, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1 FROM (SELECT *, (ca * q - cb * vab) / (p * q - vab * vab) AS w0, (cb * p - ca * vab) / (p * q - vab * vab) AS w1 FROM (SELECT *, va + {extra} AS p, vb + {extra} AS q FROM ({TWO})))"


@query(_two_sql("0"))
def ols_2f(spark, sf_dir):
    return _coefficients(spark, linear.LinearRegression().fit(priced(spark, sf_dir, ["l_quantity", "l_discount"])))


@query(_two_sql("10.0 / n"))
def ridge_2f(spark, sf_dir):
    return _coefficients(spark, linear.RidgeRegression(10.0).fit(priced(spark, sf_dir, ["l_quantity", "l_discount"])))


@query(f"SELECT {', '.join(LINE_KEYS)}, round(b + w * l_quantity, 4) + 0.0 AS prediction FROM lineitem, (SELECT c / v AS w, my - c / v * mx AS b FROM ({MOMENTS}))")
def ols_predict(spark, sf_dir):
    data = priced(spark, sf_dir, ["l_quantity"])
    return rounded(linear.LinearRegression().fit(data).predict(data), LINE_KEYS, ["prediction"], 4)


def _newton_sql(label: str, rounds: int = 12) -> str:
    """Newton steps of a penalised logistic fit of one feature, unrolled."""
    sql = f"WITH d AS (SELECT l_quantity AS x, ({label})::DOUBLE AS y FROM lineitem), t0 AS (SELECT ln(avg(y) / (1 - avg(y))) AS b, 0.0::DOUBLE AS w FROM d)"
    for i in range(rounds):
        sql += f""", s{i} AS (SELECT sum(h) AS h0, sum(h * x) AS h1, sum(h * x * x) + 1 AS h2, sum(z) AS g0, sum(z * x) AS g1 FROM (SELECT x, p * (1 - p) AS h, p * (1 - p) * s + y - p AS z FROM (SELECT x, y, b + w * x AS s, 1 / (1 + exp(-(b + w * x))) AS p FROM d, t{i}))),
t{i + 1} AS (SELECT (g0 * h2 - g1 * h1) / (h0 * h2 - h1 * h1) AS b, (g1 * h0 - g0 * h1) / (h0 * h2 - h1 * h1) AS w FROM s{i})"""
    return sql + f" SELECT round(b, 6) + 0.0 AS intercept, round(w, 6) + 0.0 AS w0 FROM t{rounds}"


@query(_newton_sql("l_linestatus = 'O'"))
def logistic(spark, sf_dir):
    model = linear.LogisticRegression().fit(Dataset(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_linestatus"))
    return numbers(spark, intercept=model.intercept, w0=model.coefficients[0])


@query(" UNION ALL ".join(f"(SELECT '{k}' AS class, * FROM ({_newton_sql(f'''l_returnflag = '{k}' ''')}))" for k in "ANR"))
def logistic_ovr(spark, sf_dir):
    model = linear.MulticlassLogisticRegression().fit(Dataset(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_returnflag"))
    rows = [(c, float(b), float(w[0])) for c, b, w in zip(model.classes, model.intercepts, model.coefficients)]
    return spark.createDataFrame(rows, "class string, intercept double, w0 double").select("class", r("intercept").alias("intercept"), r("w0").alias("w0"))


LDA = """WITH g AS (SELECT l_returnflag AS class, count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, var_pop(l_quantity) AS va, var_pop(l_discount) AS vb, covar_pop(l_quantity, l_discount) AS vab FROM lineitem GROUP BY 1),
s AS (SELECT sum(n * va) / sum(n) AS va, sum(n * vb) / sum(n) AS vb, sum(n * vab) / sum(n) AS vab, sum(n) AS total FROM g)
SELECT class, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1, round(ln(n / total) - 0.5 * (ma * w0 + mb * w1), 6) + 0.0 AS intercept FROM (
SELECT class, n, total, ma, mb, (ma * s.vb - mb * s.vab) / (s.va * s.vb - s.vab * s.vab) AS w0, (mb * s.va - ma * s.vab) / (s.va * s.vb - s.vab * s.vab) AS w1 FROM g, s)"""


@query(LDA)
def lda_2f(spark, sf_dir):
    model = linear.LinearDiscriminantAnalysis().fit(Dataset(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag"))
    rows = [(c, *map(float, w), float(b)) for c, w, b in zip(model.classes, model.coefficients, model.intercepts)]
    return spark.createDataFrame(rows, "class string, w0 double, w1 double, intercept double").select("class", *[r(c).alias(c) for c in ("w0", "w1", "intercept")])


# --- naive Bayes -----------------------------------------------------------------------------------

#: A label that the features tell something about.
KIND = "CASE WHEN p_size + p_retailprice / 100 > 40 THEN 'big' WHEN p_size % 3 = 0 THEN 'odd' ELSE 'small' END"


def kinds(spark, sf_dir) -> Dataset:
    return Dataset(table(spark, sf_dir, "part").withColumn("kind", F.expr(KIND)), ["p_size", "p_retailprice"], "kind", "p_partkey")


def _share_sql(joint: str, stats: str) -> str:
    """Probability of class 'big' by normalised joint likelihoods."""
    return f"""WITH d AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, {KIND} AS kind FROM part), {stats},
j AS (SELECT p_partkey, class, {joint} AS j FROM d, g), m AS (SELECT *, exp(j - max(j) OVER (PARTITION BY p_partkey)) AS e FROM j)
SELECT p_partkey, round(sum(CASE WHEN class = 'big' THEN e ELSE 0 END) / sum(e), 6) + 0.0 AS big FROM m GROUP BY p_partkey"""


def _big(model, data: Dataset) -> DataFrame:
    at = model.classes.index("big")
    return model.predict_probabilities(data).select("p_partkey", r(F.col("probability")[at]).alias("big"))


GNB = "g AS (SELECT kind AS class, ln(count(*) / (SELECT count(*) FROM d)) AS prior, avg(a) AS ma, avg(b) AS mb, var_pop(a) + s AS va, var_pop(b) + s AS vb FROM d, (SELECT 1e-9 * greatest(var_pop(a), var_pop(b)) AS s FROM d) GROUP BY kind, s)"


@query(_share_sql("prior - 0.5 * (ln(2 * pi() * va) + ln(2 * pi() * vb)) - (a - ma) ** 2 / (2 * va) - (b - mb) ** 2 / (2 * vb)", GNB))
def gaussian_nb(spark, sf_dir):
    data = kinds(spark, sf_dir)
    return _big(naive_bayes.GaussianNaiveBayes().fit(data), data)


MNB = "g AS (SELECT kind AS class, ln(count(*) / (SELECT count(*) FROM d)) AS prior, ln((sum(a) + 1) / (sum(a) + sum(b) + 2)) AS la, ln((sum(b) + 1) / (sum(a) + sum(b) + 2)) AS lb FROM d GROUP BY kind)"


@query(_share_sql("prior + a * la + b * lb", MNB))
def multinomial_nb(spark, sf_dir):
    data = kinds(spark, sf_dir)
    return _big(naive_bayes.MultinomialNaiveBayes().fit(data), data)


BNB = "g AS (SELECT kind AS class, ln(count(*) / (SELECT count(*) FROM d)) AS prior, (sum((a > 25)::INT) + 1) / (count(*) + 2) AS pa, (sum((b > 25)::INT) + 1) / (count(*) + 2) AS pb FROM d GROUP BY kind)"


@query(_share_sql("prior + ln(CASE WHEN a > 25 THEN pa ELSE 1 - pa END) + ln(CASE WHEN b > 25 THEN pb ELSE 1 - pb END)", BNB))
def bernoulli_nb(spark, sf_dir):
    data = kinds(spark, sf_dir)
    return _big(naive_bayes.BernoulliNaiveBayes(binarize=25.0).fit(data), data)


# --- neighbours ------------------------------------------------------------------------------------


def _accounts(spark, sf_dir, target: str) -> tuple[Dataset, Dataset]:
    """All customers, among whom the nearest are looked for, and all suppliers, who ask."""
    customers = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    features = ["c_acctbal", "nation"]
    return Dataset(customers, features, target, "c_custkey"), Dataset(suppliers, features, None, "s_suppkey")


NEAR = """WITH near AS (SELECT q.s_suppkey AS query, t.c_custkey AS id, t.c_mktsegment AS label, t.c_custkey AS y, sqrt((q.s_acctbal - t.c_acctbal) ** 2 + (q.s_nationkey - t.c_nationkey) ** 2) AS d,
row_number() OVER (PARTITION BY q.s_suppkey ORDER BY sqrt((q.s_acctbal - t.c_acctbal) ** 2 + (q.s_nationkey - t.c_nationkey) ** 2), t.c_custkey) AS k
FROM supplier q, customer t QUALIFY k <= 5)
"""


@query(NEAR + "SELECT query, k::INTEGER AS rank, id AS train_id, round(d, 6) + 0.0 AS distance FROM near")
def nearest_neighbors(spark, sf_dir):
    train, asked = _accounts(spark, sf_dir, "c_mktsegment")
    return neighbors.nearest_neighbors(train, asked, 5).select("query", "rank", "train_id", r("distance").alias("distance"))


@query(NEAR + ", v AS (SELECT query, label, count(*) AS n FROM near GROUP BY ALL) SELECT query AS s_suppkey, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1")
def knn_classify(spark, sf_dir):
    train, asked = _accounts(spark, sf_dir, "c_mktsegment")
    return neighbors.KNeighborsClassifier(5).fit(train).predict(asked).select("s_suppkey", "prediction")


@query(NEAR + "SELECT query AS s_suppkey, round(CASE WHEN min(d) <= 1e-12 THEN arg_min(y, k) ELSE sum(y / d) / sum(1 / d) END, 4) + 0.0 AS prediction FROM near GROUP BY query")
def knn_regress_distance(spark, sf_dir):
    train, asked = _accounts(spark, sf_dir, "c_custkey")
    return rounded(neighbors.KNeighborsRegressor(5, "distance").fit(train).predict(asked), ["s_suppkey"], ["prediction"], 4)


# --- decomposition and clusters --------------------------------------------------------------------

PCA = """WITH m AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_samp(p_size) AS a, var_samp(p_retailprice) AS b, covar_samp(p_size, p_retailprice) AS c FROM part),
e AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS l2 FROM m),
v AS (SELECT *, sqrt(c * c + (l1 - a) ** 2) AS len FROM e), w AS (SELECT *, c / len AS x, (l1 - a) / len AS y FROM v), o AS (SELECT *, CASE WHEN (CASE WHEN abs(x) > abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS s FROM w)
"""


@query(PCA + "SELECT round(l1, 4) + 0.0 AS v1, round(l2, 4) + 0.0 AS v2, round(l1 / (l1 + l2), 6) + 0.0 AS ratio FROM o")
def pca_variance(spark, sf_dir):
    model = decomposition.PrincipalComponentAnalysis().fit(parts(spark, sf_dir))
    v1, v2 = model.explained_variance
    return spark.range(1).select(r(F.lit(v1), 4).alias("v1"), r(F.lit(v2), 4).alias("v2"), r(F.lit(model.explained_variance_ratio[0])).alias("ratio"))


@query(PCA + "SELECT p_partkey, round((p_size - ma) * x * s + (p_retailprice - mb) * y * s, 4) + 0.0 AS pc1 FROM part, o")
def pca_transform(spark, sf_dir):
    data = parts(spark, sf_dir)
    return rounded(decomposition.PrincipalComponentAnalysis(1).fit(data).transform(data).df, ["p_partkey"], ["pc1"], 4)


def _lloyd_sql(start: str, rounds: int = 5) -> str:
    """Rounds from a start, which tells c0 (i, c) of the rows d (event_id, value)."""
    sql = f"WITH d AS (SELECT event_id, value FROM events), {start}"
    for j in range(rounds):
        sql += f", a{j} AS (SELECT event_id, value, (SELECT i FROM c{j} ORDER BY (value - c) ** 2, i LIMIT 1) AS i FROM d), c{j + 1} AS (SELECT c{j}.i, coalesce(avg(value), any_value(c)) AS c FROM c{j} LEFT JOIN a{j} USING (i) GROUP BY c{j}.i)"
    return sql + f" SELECT event_id, (SELECT i FROM c{rounds} ORDER BY (value - c) ** 2, i LIMIT 1) AS cluster FROM d"


def _first_three(order: str) -> str:
    return f"c0 AS (SELECT (row_number() OVER (ORDER BY {order}) - 1)::INT AS i, value AS c FROM (SELECT * FROM d ORDER BY {order} LIMIT 3))"


def _race(j: int, chosen: str) -> str:
    """The winner of an exponential race at rates of squared distances from the rows chosen before."""
    u = f"(('0x' || substr(md5(concat_ws('-', event_id::VARCHAR, '42', '{j}')), 1, 13))::BIGINT + 0.5) / 2.0::DOUBLE ** 52"
    return f"SELECT {j} AS i, value AS c FROM (SELECT value, -ln({u}) / nullif((SELECT min((value - c) ** 2) FROM ({chosen})), 0) AS race FROM d) ORDER BY race NULLS LAST, value LIMIT 1"


DRAW = "md5(concat_ws('-', event_id::VARCHAR, '42'))"
PLUSPLUS = f"p0 AS MATERIALIZED (SELECT 0 AS i, value AS c FROM d ORDER BY {DRAW} LIMIT 1), p1 AS MATERIALIZED ({_race(1, 'FROM p0')}), p2 AS MATERIALIZED ({_race(2, 'FROM p0 UNION ALL FROM p1')}), c0 AS (FROM p0 UNION ALL FROM p1 UNION ALL FROM p2)"


def _five_rounds(name: str, init: str, start: str) -> None:
    @query(_lloyd_sql(start), name)
    def run(spark, sf_dir):
        data = Dataset(table(spark, sf_dir, "events"), ["value"], None, "event_id")
        return cluster.KMeans(3, init=init, max_iterations=5, tolerance=1e-300).fit(data).predict(data).select("event_id", "cluster")


_five_rounds("kmeans_five_rounds", "first", _first_three("event_id"))
_five_rounds("kmeans_random_start", "random", _first_three(DRAW))
_five_rounds("kmeans_plusplus_start", "plusplus", PLUSPLUS)


DENSITY = """WITH d AS (SELECT c_custkey, c_acctbal AS x FROM customer),
n AS (SELECT *, count(*) OVER (ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 4 AS core FROM d),
g AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x, c_custkey) <= 2 THEN 0 ELSE 1 END AS jump FROM n WHERE core),
i AS (SELECT *, sum(jump) OVER (ORDER BY x, c_custkey) AS island FROM g),
f AS (SELECT island, dense_rank() OVER (ORDER BY min(c_custkey)) - 1 AS cluster FROM i GROUP BY island),
c AS (SELECT c_custkey, x, cluster FROM i JOIN f USING (island))
SELECT d.c_custkey AS row, (CASE WHEN bool_or(c.c_custkey = d.c_custkey) THEN max(CASE WHEN c.c_custkey = d.c_custkey THEN cluster END) ELSE coalesce(min(cluster), -1) END)::INT AS cluster
FROM d LEFT JOIN c ON abs(d.x - c.x) <= 2 GROUP BY d.c_custkey"""


@query(DENSITY)
def dbscan(spark, sf_dir):
    return cluster.Dbscan(2.0, 4).fit(Dataset(table(spark, sf_dir, "customer"), ["c_acctbal"], None, "c_custkey")).labels.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@query()
def gaussian_mixture(spark, sf_dir):
    data = Dataset(table(spark, sf_dir, "events"), ["value"], None, "event_id")
    model = cluster.GaussianMixture(2).fit(data)
    return model.predict(data, "component").select("event_id", "component")


@query("SELECT event_id % 2 AS side, round(count(*) / (SELECT count(*) FROM events), 6) AS weight, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value) + 1e-6, 4) AS variance FROM events GROUP BY 1")
def gaussian_mixture_apart(spark, sf_dir):
    """Two components of which every row belongs to one alone: their moments are those of the two sides."""
    df = table(spark, sf_dir, "events").withColumn("moved", F.col("value") + F.col("event_id") % 2 * 1e4)
    model = cluster.GaussianMixture(2).fit(Dataset(df, ["moved"], None, "event_id"))
    found = sorted(zip(model.weights, model.means, model.covariances), key=lambda c: c[1])
    rows = [(side, float(w), float(m[0]) - 1e4 * side, float(v[0][0])) for side, (w, m, v) in enumerate(found)]
    return spark.createDataFrame(rows, "side long, weight double, mean double, variance double").select("side", r("weight").alias("weight"), r("mean").alias("mean"), r("variance", 4).alias("variance"))


# --- trees -----------------------------------------------------------------------------------------


def _stump_sql(score: str, stats: str, columns: tuple[str, ...] = ("p_size", "p_retailprice"), y: str = "0") -> str:
    """The best midpoint of each feature by prefix sums."""
    parts_ = " UNION ALL ".join(f"SELECT {j} AS feature, {c}::DOUBLE AS v, count(*)::DOUBLE AS n, {stats} FROM d GROUP BY {c}" for j, c in enumerate(columns))
    return f"WITH d AS (SELECT *, {y} AS y FROM part), h AS ({parts_}), {score}"


REGRESSION_STUMP = _stump_sql(
    """p AS (SELECT feature, v, lead(v) OVER w AS nxt, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s, sum(q) OVER (PARTITION BY feature) AS q FROM h WINDOW w AS (PARTITION BY feature ORDER BY v)),
e AS (SELECT feature, v + (nxt - v) / 2 AS t, ls / ln AS lo, (s - ls) / (n - ln) AS hi, round((lq - ls * ls / ln + (q - lq) - (s - ls) ** 2 / (n - ln)) / n, 6) AS score FROM p WHERE nxt IS NOT NULL)
SELECT feature::INT AS feature, round(t, 4) + 0.0 AS threshold, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high FROM e ORDER BY score, feature, t LIMIT 1""",
    "sum(y) AS s, sum(y * y) AS q",
    y="p_size * 2.0 + CASE WHEN p_retailprice > 1200 THEN 60 ELSE 0 END",
)


@query(REGRESSION_STUMP)
def tree_stump_regression(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("y", F.expr("p_size * 2.0D + CASE WHEN p_retailprice > 1200 THEN 60 ELSE 0 END"))
    tree = trees.DecisionTreeRegressor(1).fit(Dataset(df, ["p_size", "p_retailprice"], "y", "p_partkey")).trees[0]
    return _stump(spark, tree, 0)


def _stump(spark, tree, place: int) -> DataFrame:
    low, high = tree.value[tree.left[0]][place], tree.value[tree.right[0]][place]
    return spark.range(1).select(F.lit(tree.feature[0]).alias("feature"), r(F.lit(float(tree.threshold[0])), 4).alias("threshold"), r(F.lit(float(low))).alias("low"), r(F.lit(float(high))).alias("high"))


CLASS_STUMP = _stump_sql(
    """p AS (SELECT feature, v, lead(v) OVER w AS nxt, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s FROM h WINDOW w AS (PARTITION BY feature ORDER BY v)),
e AS (SELECT feature, v + (nxt - v) / 2 AS t, ls / ln AS lo, (s - ls) / (n - ln) AS hi, round((ln - (ls * ls + (ln - ls) ** 2) / ln + (n - ln) - ((s - ls) ** 2 + (n - ln - s + ls) ** 2) / (n - ln)) / n, 12) AS score FROM p WHERE nxt IS NOT NULL)
SELECT feature::INT AS feature, round(t, 4) + 0.0 AS threshold, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high FROM e ORDER BY score, feature, t LIMIT 1""",
    "sum(y)::DOUBLE AS s",
    y="(p_size > 30 OR p_retailprice > 1800)::INT",
)


def _large(spark, sf_dir) -> Dataset:
    df = table(spark, sf_dir, "part").withColumn("large", (F.col("p_size") > 30) | (F.col("p_retailprice") > 1800))
    return Dataset(df, ["p_size", "p_retailprice"], "large", "p_partkey")


@query(CLASS_STUMP)
def tree_stump_classification(spark, sf_dir):
    return _stump(spark, trees.DecisionTreeClassifier(1).fit(_large(spark, sf_dir)).trees[0], 1)


@query(CLASS_STUMP)
def tree_stump_distributed(spark, sf_dir):
    return _stump(spark, trees.DecisionTreeClassifier(1, local_rows=10).fit(_large(spark, sf_dir)).trees[0], 1)


@query("SELECT p_partkey, (p_size > 30 OR p_retailprice > 1800) AS prediction FROM part")
def decision_tree_classifier(spark, sf_dir):
    data = _large(spark, sf_dir)
    return trees.DecisionTreeClassifier().fit(data).predict(data).select("p_partkey", "prediction")


@query("SELECT p_partkey, p_size * 2.0 AS prediction FROM part")
def decision_tree_regressor(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("y", F.expr("p_size * 2.0D"))
    data = Dataset(df, ["p_size", "p_retailprice"], "y", "p_partkey")
    return rounded(trees.DecisionTreeRegressor().fit(data).predict(data), ["p_partkey"], ["prediction"])


def _ensemble(name: str, estimator, numeric: bool):
    @query(None, name)
    def fit(spark, sf_dir):
        data = _large(spark, sf_dir)
        if numeric:
            data = Dataset(data.df.withColumn("y", F.expr("p_size * 2.0D + p_retailprice / 100")), data.features, "y", data.row_id)
        return estimator.fit(data).predict(data).select("p_partkey", "prediction")


_ensemble("random_forest_classifier", trees.RandomForestClassifier(n_estimators=10), False)
_ensemble("random_forest_regressor", trees.RandomForestRegressor(n_estimators=10, max_depth=6), True)
_ensemble("gradient_boosting_classifier", trees.GradientBoostingClassifier(n_estimators=10), False)
_ensemble("gradient_boosting_regressor", trees.GradientBoostingRegressor(n_estimators=10), True)
_ensemble("adaboost_classifier", trees.AdaBoostClassifier(n_estimators=10), False)


def _boosted(stump: str, value: str) -> str:
    """What one round on a stump predicts for every row: `value` of the leaf's mean m and of all rows' mean p."""
    return f"WITH best AS ({stump}), q AS (SELECT *, CASE WHEN (CASE feature WHEN 0 THEN p_size ELSE p_retailprice END) <= threshold THEN low ELSE high END AS m FROM part, best) SELECT p_partkey, {value} AS prediction FROM q, (SELECT avg(y) AS p FROM (SELECT *, {{y}} AS y FROM part))"


SIZED = "p_size * 2.0 + CASE WHEN p_retailprice > 1200 THEN 60 ELSE 0 END"


@query(_boosted(REGRESSION_STUMP, "round(p + 0.1 * (m - p), 4) + 0.0").format(y=SIZED))
def gradient_boosting_round(spark, sf_dir):
    """One round of depth 1, grown over Spark: the mean, and a tenth of the way to the leaf's."""
    df = table(spark, sf_dir, "part").withColumn("y", F.expr(SIZED.replace("2.0", "2.0D")))
    data = Dataset(df, ["p_size", "p_retailprice"], "y", "p_partkey")
    model = trees.GradientBoostingRegressor(n_estimators=1, max_depth=1, local_rows=10).fit(data)
    return rounded(model.predict(data), ["p_partkey"], ["prediction"], 4)


@query(_boosted(CLASS_STUMP, "ln(p / (1 - p)) + (m - p) / (p * (1 - p)) >= 0").format(y="(p_size > 30 OR p_retailprice > 1800)::INT"))
def gradient_boosting_class_round(spark, sf_dir):
    """One round of depth 1: a Newton step from the classes' log odds."""
    data = _large(spark, sf_dir)
    model = trees.GradientBoostingClassifier(n_estimators=1, max_depth=1, learning_rate=1.0).fit(data)
    return model.predict(data).select("p_partkey", "prediction")


@query(_boosted(CLASS_STUMP, "m > 0.5").format(y="(p_size > 30 OR p_retailprice > 1800)::INT"))
def adaboost_round(spark, sf_dir):
    """One round: the stump's own prediction."""
    data = _large(spark, sf_dir)
    return trees.AdaBoostClassifier(n_estimators=1).fit(data).predict(data).select("p_partkey", "prediction")


# --- model selection -------------------------------------------------------------------------------

FOLDS = "SELECT o_orderkey::DOUBLE AS x, o_totalprice AS y, (row_number() OVER (ORDER BY md5(concat_ws('-', o_orderkey::VARCHAR, '42')), o_orderkey) - 1) AS p, count(*) OVER () AS n FROM orders"


def _cv_sql(alphas: list[float]) -> str:
    """Mean squared error of ridge fits of one feature by fold."""
    rows = ", ".join(f"({a})" for a in alphas)
    return f"""WITH o AS ({FOLDS}), d AS (SELECT x, y, CASE WHEN p < (n % 3) * (n // 3 + 1) THEN p // (n // 3 + 1) ELSE (n % 3) + (p - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM o),
f AS (SELECT k.fold AS k, a, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM d, (SELECT DISTINCT fold FROM d) k, (VALUES {rows}) t(a) WHERE d.fold <> k.fold GROUP BY ALL),
w AS (SELECT *, n * c / (n * v + a) AS w FROM f), s AS (SELECT a, k, avg((y - my - w * (x - mx)) ** 2) AS score FROM d JOIN w ON d.fold = w.k GROUP BY a, k)
"""


def folded(spark, sf_dir) -> Dataset:
    data = Dataset(table(spark, sf_dir, "orders").withColumn("x", F.col("o_orderkey").cast("double")), ["x"], "o_totalprice", "o_orderkey")
    return data.with_df(ms.KFold(3, shuffle=True).split(data).cache())


@query(_cv_sql([1.0]) + "SELECT k::INTEGER AS fold, round(score, 0) + 0.0 AS score FROM s")
def cross_validate(spark, sf_dir):
    found = ms.cross_validate_parallel(linear.RidgeRegression(1.0), folded(spark, sf_dir), metrics.mean_squared_error)
    return spark.createDataFrame(list(enumerate(map(float, found.scores))), "fold int, score double").select("fold", r("score", 0).alias("score"))


ALPHAS = [1.0, 1e12, 1e14]


@query(_cv_sql(ALPHAS) + "SELECT a::DOUBLE AS alpha, round(avg(score), 0) + 0.0 AS mean_score, (rank() OVER (ORDER BY avg(score)))::INTEGER AS rank FROM s GROUP BY a")
def grid_search(spark, sf_dir):
    grid = ms.ParameterGrid().with_parameter("alpha", ALPHAS)
    found = ms.grid_search_parallel(grid, lambda p: linear.RidgeRegression(p["alpha"]), folded(spark, sf_dir), metrics.mean_squared_error, ms.MINIMIZE)
    rows = [(e.parameters["alpha"], float(e.mean_score), e.rank) for e in found.entries]
    return spark.createDataFrame(rows, "alpha double, mean_score double, rank int").select("alpha", r("mean_score", 0).alias("mean_score"), "rank")


@query(_cv_sql(ALPHAS) + "SELECT a::DOUBLE AS alpha, k::INTEGER AS fold, round(score, 0) + 0.0 AS test_score FROM s")
def validation_curve(spark, sf_dir):
    found = ms.validation_curve(ALPHAS, linear.RidgeRegression, folded(spark, sf_dir), metrics.mean_squared_error, parallel=4)
    rows = [(a, k, float(v)) for a, scores in zip(ALPHAS, found.test_scores) for k, v in enumerate(scores)]
    return spark.createDataFrame(rows, "alpha double, fold int, test_score double").withColumn("test_score", r("test_score", 0))


SEARCHED = ms.ParameterGrid().with_parameter("alpha", ALPHAS)
#: The operator draws by a generator of its own; what is checked is what becomes of the draws.
DRAWN = ", ".join(f"({p['alpha']})" for p in SEARCHED.sample_combinations(4, 7))


@query(_cv_sql(ALPHAS) + f", m AS (SELECT a, avg(score) AS score FROM s GROUP BY a) SELECT a::DOUBLE AS alpha, round(score, 0) + 0.0 AS mean_score, (rank() OVER (ORDER BY score))::INTEGER AS rank FROM m JOIN (VALUES {DRAWN}) t(d) ON a = d")
def randomized_search(spark, sf_dir):
    found = ms.randomized_search_parallel(SEARCHED, 4, 7, lambda p: linear.RidgeRegression(p["alpha"]), folded(spark, sf_dir), metrics.mean_squared_error, ms.MINIMIZE)
    rows = [(e.parameters["alpha"], float(e.mean_score), e.rank) for e in found.entries]
    return spark.createDataFrame(rows, "alpha double, mean_score double, rank int").withColumn("mean_score", r("mean_score", 0))


SHARES = [0.1, 0.5, 1.0]
LEARNING = _cv_sql([1.0]).split("f AS (")[0] + """tr AS (SELECT k.fold AS k, x, y, row_number() OVER (PARTITION BY k.fold ORDER BY x) AS place, count(*) OVER (PARTITION BY k.fold) AS n FROM d, (SELECT DISTINCT fold FROM d) k WHERE d.fold <> k.fold),
f AS (SELECT k, share, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM tr, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(share) WHERE place <= floor(share * tr.n) GROUP BY ALL)
SELECT share, k::INTEGER AS fold, round(avg((y - my - n * c / (n * v + 1) * (x - mx)) ** 2), 0) + 0.0 AS test_score FROM d JOIN f ON d.fold = f.k GROUP BY share, k"""


@query(LEARNING)
def learning_curve(spark, sf_dir):
    """Fits on shares of each fold's training rows, up to all of them."""
    found = ms.learning_curve(linear.RidgeRegression(1.0), SHARES, folded(spark, sf_dir), metrics.mean_squared_error, parallel=4)
    rows = [(n, k, float(v)) for n, scores in zip(SHARES, found.test_scores) for k, v in enumerate(scores)]
    return spark.createDataFrame(rows, "share double, fold int, test_score double").withColumn("test_score", r("test_score", 0))


def _dealt(feature: int, repeat: int) -> str:
    """Mean squared change of 2 * p_size when its values change places, by the operator's order of md5."""
    seed = hash((42, feature, repeat)) % (1 << 31)
    return f"""SELECT avg((2.0 * a.p_size - 2.0 * b.p_size) ** 2) AS score FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS place FROM part) a
JOIN (SELECT p_size, row_number() OVER (ORDER BY md5(concat_ws('-', p_partkey::VARCHAR, '{seed}')), p_partkey) AS place FROM part) b ON a.place = b.place"""


@query(f"SELECT 'p_size' AS feature, round(avg(score), 4) + 0.0 AS importance FROM ({_dealt(0, 0)} UNION ALL {_dealt(0, 1)}) UNION ALL SELECT 'p_retailprice', 0.0")
def permutation_importance(spark, sf_dir):
    data = Dataset(table(spark, sf_dir, "part").withColumn("y", F.expr("p_size * 2.0D")), ["p_size", "p_retailprice"], "y", "p_partkey")
    found = inspection.permutation_importance(linear.LinearRegression().fit(data), data, metrics.mean_squared_error, ms.MINIMIZE, 2, parallel=4)
    rows = list(zip(data.features, map(float, found.importances_mean)))
    return spark.createDataFrame(rows, "feature string, importance double").withColumn("importance", r("importance", 4))


STEPS = f"""WITH filled AS (SELECT {', '.join(LINE_KEYS)}, l_quantity AS q, coalesce(nullif(l_tax, 0.05), (SELECT avg(nullif(l_tax, 0.05)) FROM lineitem)) AS t FROM lineitem),
scaled AS (SELECT {', '.join(LINE_KEYS)}, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS q, (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) AS t FROM filled)
SELECT {', '.join(LINE_KEYS)}, round(q, 6) + 0.0 AS a, round(t, 6) + 0.0 AS b, round(q * q, 6) + 0.0 AS c, round(q * t, 6) + 0.0 AS d, round(t * t, 6) + 0.0 AS e FROM scaled"""


@query(STEPS)
def pipeline_steps(spark, sf_dir):
    """Fill, scale and multiply: each step is fitted to what the one before makes."""
    data = _with_gaps(spark, sf_dir)
    steps = Pipeline().then(preprocessing.SimpleImputer.mean()).then(preprocessing.MinMaxScaler()).then(preprocessing.PolynomialFeatures(2, include_bias=False))
    made = steps.fit(data).transform(data)
    return made.df.select(*LINE_KEYS, *[r(col(c)).alias(n) for c, n in zip(made.features, "abcde")])


FLAGSHIP = """WITH s AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS b, {y} AS y FROM lineitem),
m AS (SELECT avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb FROM s),
w AS (SELECT *, (ca * vb - cb * vab) / (va * vb - vab * vab) AS w0, (cb * va - ca * vab) / (va * vb - vab * vab) AS w1 FROM m)
SELECT round(any_value(my), 6) + 0.0 AS intercept, round(any_value(w0), 6) + 0.0 AS w0, round(any_value(w1), 6) + 0.0 AS w1, round(avg((y - my - w0 * a - w1 * b) ** 2), 6) + 0.0 AS mse, round(1 - avg((y - my - w0 * a - w1 * b) ** 2) / var_pop(y), 6) + 0.0 AS r2 FROM s, w""".format(y=PRICE)


@query(FLAGSHIP)
def pipeline_regression(spark, sf_dir):
    """Scale, fit, predict and score: the flagship query."""
    data = priced(spark, sf_dir, ["l_quantity", "l_discount"])
    model = Pipeline().then(preprocessing.StandardScaler()).with_estimator(linear.LinearRegression()).fit(data)
    made = model.predict(data)
    return numbers(
        spark,
        intercept=model.model.intercept,
        w0=model.model.coefficients[0],
        w1=model.model.coefficients[1],
        mse=metrics.mean_squared_error(made, "y", "prediction"),
        r2=metrics.r2_score(made, "y", "prediction"),
    )
