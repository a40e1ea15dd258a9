"""Models: folds, nested validation, transfer, importance, kriging. Random fits have no SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.functions import fuzzy
from strataflow.functions.fuzzy import impute_median
from strataflow.operators import drift, kriging, metrics, models, spatial, validation
from strataflow.operators.raster import cell_number
from strataflow.plans.registry import query
from strataflow.session import cut, scratch_path

C = F.col
FEATURES = ["depth_m", "flow", "static_sheet", "hours", "qs_cadastre"]


#: The registered queries' sizes, below the library's defaults: a forest of 500 trees for each of 10 seeds, 5 folds and 3 depths takes hours on one machine.
SMALL = {"trees": 20}
SHORT = {"rounds": 5}


def matrix(spark, sf_dir):
    """Wells with features (which may be missing), coordinates and the target; checkpointed, as models pass over it many times."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z", *FEATURES)
    q = metrics.quantiles(w, "z", [0.75], ["q"])
    w = w.crossJoin(F.broadcast(q)).withColumn("t", (C("z") >= C("q")).cast("int"))
    return cut(w.select("code", "x", C("y").alias("north"), "z", C("t").alias("y"), *FEATURES))


def fitted(kind, features, train, **size):
    """A model of ``train``."""
    return models.classifier(kind, features, 42, **size).fit(train)


def folded(m, size, folds, seed):
    return models.spatial_folds(m.withColumnRenamed("y", "t").withColumnRenamed("north", "y"), size, folds, seed).withColumnRenamed("y", "north").withColumnRenamed("t", "y")


@query("spatial_folds")
def spatial_folds(spark, sf_dir):
    """Wells and blocks by fold of a seeded deal of 10 km blocks."""
    f = folded(matrix(spark, sf_dir), 10000.0, 5, 42)
    return f.groupBy("fold").agg(F.count("*").alias("wells"), F.sum("y").alias("positives"))


@query("nested_cv")
def nested_cv(spark, sf_dir, seeds=2, folds=3, depths=(3, 5), inner=2, trees=20, rounds=5, at_once=validation.AT_ONCE):
    """Out-of-fold AUC of forest, boosted trees, their mean and the fuzzy score on the same rows, over spatial folds; the depth is chosen inside each training side."""
    m = matrix(spark, sf_dir)
    got = validation.nested_validation(placed(m), FEATURES, scratch_path(spark, "nested-cv"), 10000.0, seeds, folds, inner, depths, trees, rounds, at_once)
    fuzzy_score = fuzzy.gamma_score(m, [("depth_m", False), ("flow", False), ("static_sheet", True)], "p_fuzzy").select("code", "p_fuzzy")
    scores = validation.class_scores(got.join(fuzzy_score, "code"), {"forest": "p_rf", "boosted": "p_gbt", "mean": "p_mean", "fuzzy": "p_fuzzy"})
    return scores.select("seed", "model", "n", F.round("auc", 6).alias("auc"))


@query("regression_cv")
def regression_cv(spark, sf_dir, seeds=2, folds=3, depths=(5,), inner=2, trees=20, rounds=5, at_once=validation.AT_ONCE):
    """R2 and RMSE of z, out of fold over spatial blocks, by seed: forest, boosted trees and their mean."""
    got = validation.nested_validation(placed(matrix(spark, sf_dir)), FEATURES, scratch_path(spark, "regression-cv"), 10000.0, seeds, folds, inner, depths, trees, rounds, at_once)
    scores = validation.value_scores(got, {"forest": "z_rf", "boosted": "z_gbt", "mean": "z_mean"})
    return scores.select("seed", "model", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 6).alias("rmse"))


def placed(m):
    """The matrix with its coordinates as bx and by, from which blocks are made."""
    return m.withColumnsRenamed({"x": "bx", "north": "by"})


def out_of_fold(spark, sf_dir, seeds=1, folds=3):
    """The out-of-fold table at the registered queries' sizes."""
    return validation.nested_validation(placed(matrix(spark, sf_dir)), FEATURES, scratch_path(spark, "out-of-fold"), 10000.0, seeds, folds, 2, (5,), **SMALL, **SHORT)


@query("out_of_fold_table")
def out_of_fold_table(spark, sf_dir):
    """Every well's fold, out-of-fold probabilities and values."""
    cols = ("z", "p_rf", "p_gbt", "p_mean", "z_rf", "z_gbt", "z_mean")
    return out_of_fold(spark, sf_dir).select("code", "fold", "y", *[F.round(p, 6).alias(p) for p in cols])


@query("external_validation")
def external_validation(spark, sf_dir):
    """Forest and boosted trees fitted inside a sub-area, with threshold and medians from there alone, tested outside: AUC of the class, R2 and RMSE of the value."""
    m, rows = matrix(spark, sf_dir), None
    inside = C("x").between(0, 30000) & C("north").between(0, 30000)
    q = metrics.quantiles(m.where(inside), "z", [0.75], ["q"])
    m = cut(m.drop("y").crossJoin(F.broadcast(q)).withColumn("y", (C("z") >= C("q")).cast("int")))
    m = cut(impute_median(m, FEATURES, m.where(inside)))
    train, test = m.where(inside), validation.enough(m.where(~inside))
    for kind, size in (("rf", SMALL), ("gbt", SHORT)):
        got = models.predict(fitted(kind, FEATURES, train, **size), test)
        got = cut(models.predict_value(models.regressor(kind, FEATURES, 42, **size).fit(train), got))
        auc, value = metrics.auc(got, "y", "p"), metrics.r2_rmse(got, "z", "v").drop("n")
        one = auc.crossJoin(F.broadcast(value)).select(F.lit(kind).alias("model"), "n", "positives", *[F.round(c, 6).alias(c) for c in ("auc", "r2", "rmse")])
        rows = one if rows is None else rows.unionByName(one)
    return rows


#: Predictors of transfer between areas, which coordinates never are.
COVARIATES = {"all": FEATURES, "without_depth": FEATURES[1:], "levels": ["static_sheet", "depth_m"]}


@query("cross_area")
def cross_area(spark, sf_dir):
    """Transfer between two areas in both directions with three sets of covariates, each area's own threshold, and the training side's medians."""
    m, rows = matrix(spark, sf_dir).withColumn("area", (C("x") < 30000).cast("int")), None
    q = metrics.quantiles(m, "z", [0.75], ["q"], ("area",))
    m = cut(m.drop("y").join(q, "area").withColumn("y", (C("z") >= C("q")).cast("int")))
    for a in (0, 1):
        held = cut(impute_median(m, FEATURES, m.where(C("area") == a)))
        train, test = held.where(C("area") == a), held.where(C("area") != a)
        for name, features in COVARIATES.items():
            got = metrics.auc(models.predict(fitted("rf", features, train, **SMALL), test), "y", "p")
            got = got.select(F.lit(a).alias("from_area"), F.lit(name).alias("features"), "n", F.round("auc", 6).alias("auc"))
            rows = got if rows is None else rows.unionByName(got)
    return rows


@query("permutation_importance")
def permutation_importance(spark, sf_dir, repetitions=2):
    """Mean loss of accuracy and of AUC, and its deviation, when one feature is dealt anew."""
    m, rows = cut(impute_median(matrix(spark, sf_dir), FEATURES)), None
    model = models.classifier("rf", FEATURES, 42, **SMALL).fit(m)
    whole = cut(models.predict(model, m))
    base_auc = metrics.auc(whole, "y", "p").select(C("auc").alias("auc0")).crossJoin(whole.agg(models.accuracy(whole, C("p")).alias("acc0")))
    for f in FEATURES:
        each = None
        for k in range(repetitions):
            p = models.predict(model, models.permuted(m, f, 7 + k)).select(F.lit(k).alias("rep"), "y", "p")
            each = p if each is None else each.unionByName(p)
        got = metrics.auc(each, "y", "p", keys=("rep",)).select("rep", "auc").join(each.groupBy("rep").agg(models.accuracy(each, C("p")).alias("acc")), "rep").crossJoin(F.broadcast(base_auc))
        got = got.agg(F.lit(f).alias("feature"), F.round(F.avg(C("acc0") - C("acc")), 6).alias("accuracy_loss"), F.round(F.avg(C("auc0") - C("auc")), 6).alias("auc_loss"), F.round(F.stddev_pop(C("auc0") - C("auc")), 6).alias("auc_loss_deviation"))
        rows = got if rows is None else rows.unionByName(got)
    return rows


@query("train_predict")
def train_predict(spark, sf_dir):
    """Probabilities and values of every well from the four final models, written with their predictors and provenance and read back, and the classifiers' difference."""
    m = cut(impute_median(matrix(spark, sf_dir), FEATURES))
    path = scratch_path(spark, "models")
    for name, model in (("rf_class", models.classifier("rf", FEATURES, 42, **SMALL)), ("gbt_class", models.classifier("gbt", FEATURES, 42, **SHORT)), ("rf_value", models.regressor("rf", FEATURES, 42, **SMALL)), ("gbt_value", models.regressor("gbt", FEATURES, 42, **SHORT))):
        models.save_model(model.fit(m), f"{path}/{name}", FEATURES, {"rows": "wells", "target": "z"})
    out = m
    for name, column in (("rf_class", "p_rf"), ("gbt_class", "p_gbt"), ("rf_value", "z_rf"), ("gbt_value", "z_gbt")):
        model, features, _ = models.load_model(spark, f"{path}/{name}")
        out = (models.predict if name.endswith("class") else models.predict_value)(model, out.select(*[c for c in out.columns if c not in features], *features), column)
    return out.select("code", "y", *[F.round(c, 6).alias(c) for c in ("p_rf", "p_gbt", "z_rf", "z_gbt")], F.round(F.abs(C("p_rf") - C("p_gbt")), 6).alias("gap"))


@query("raster_prediction")
def raster_prediction(spark, sf_dir):
    """Probabilities on every grid cell from a stack of rasters, with their models' difference and the distance to the nearest well of the training set.

    Terrain height, its slope and a coarse raster of another origin are written to two
    folders and read back by name; the wells take the values of their places, and the models
    go over the aligned stack.
    """
    from strataflow.operators import raster
    from strataflow.plans import raster as raster_plans
    from strataflow.sources import georaster

    terrain = raster_plans.on_the_grid(spark, sf_dir)
    g = raster.gradient(terrain.cells, raster_plans.RES)
    slope = georaster.Raster(g.select("r", "c", F.hypot("gr", "gc").alias("v")), terrain.place)
    folders = [scratch_path(spark, "covariates"), scratch_path(spark, "surfaces")]
    for folder, name, one in ((folders[0], "terrain", terrain), (folders[0], "slope", slope), (folders[1], "coarse", raster_plans.coarse(spark, sf_dir))):
        one.write(f"{folder}/{name}")
    names = ["terrain", "slope", "coarse"]
    rasters = {n: georaster.read(spark, folders, n) for n in names}
    m = matrix(spark, sf_dir).select("code", "x", C("north").alias("y"), C("y").alias("target"))
    train = cut(models.in_order(impute_median(georaster.at_points(m, rasters), names).fillna(0.0, names)))
    cells_ = georaster.stack(rasters, terrain.place)
    held = cut(impute_median(cells_, names).fillna(0.0, names))
    labelled = train.drop("y").withColumnRenamed("target", "y")
    rf, gbt = fitted("rf", names, labelled, **SMALL), fitted("gbt", names, labelled, **SHORT)
    got = models.predict(gbt, models.predict(rf, held, "p"), "p_gbt")
    x, y = terrain.place.centre(C("r"), C("c"))
    here = terrain.place.cells(spark).select(F.struct("r", "c").alias("code"), x.alias("x"), y.alias("y"))
    near = spatial.nearest(here, train.select(F.struct("code", F.lit(0).alias("k")).alias("code"), "x", "y"), 1).select("a.r", "a.c", C("d").alias("support"))
    return got.join(near, ["r", "c"]).select("r", "c", F.round("p", 6).alias("p"), F.round(F.abs(C("p") - C("p_gbt")), 6).alias("gap"), F.round("support", 6).alias("support"))


@query("random_vs_spatial")
def random_vs_spatial(spark, sf_dir):
    """AUC with random folds, dealt within each class, beside AUC with spatial ones."""
    f, rows = folded(matrix(spark, sf_dir), 10000.0, 3, 42), None
    # within 64 hash groups of a class, rows are dealt in turn
    f = f.withColumn("deal", ((F.expr("row_number() over (partition by y, pmod(xxhash64(code), 64) order by xxhash64(code, 1), code)") + F.pmod(F.xxhash64("code"), F.lit(64))) % 3).cast("int"))
    f = cut(f)
    for name, fold in (("spatial", "fold"), ("random", "deal")):
        got = metrics.auc(models.cross_validate(f, FEATURES, "rf", fold, 3, 42, (5,), **SMALL), "y", "p").select(F.lit(name).alias("folds"), "n", F.round("auc", 6).alias("auc"))
        rows = got if rows is None else rows.unionByName(got)
    return rows


LAGS = (0, 500, 1000, 2000, 3000, 4000)


def cells(spark, sf_dir):
    return relation(spark, sf_dir, "grid").select(cell_number().alias("code"), ((C("c") + 0.5) * 1500).alias("x"), ((C("r") + 0.5) * 1500).alias("y"))


@query("ok_kriging")
def ok_kriging(spark, sf_dir):
    """Ordinary kriging of z on the grid."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    return kriging.ordinary_kriging(w, "z", cells(spark, sf_dir), LAGS).select(C("code").alias("cell"), F.round("estimate", 6).alias("estimate"))


def wells_on_terrain(spark, sf_dir):
    """Wells with the terrain height of their grid cell as ``v``, and the grid's cells with theirs."""
    grid = relation(spark, sf_dir, "grid")
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z", "depth_m", "hours", F.floor(C("y") / 1500).cast("int").alias("r"), F.floor(C("x") / 1500).cast("int").alias("c"))
    return w.join(grid, ["r", "c"]).drop("r", "c"), cells(spark, sf_dir).join(grid.select(cell_number().alias("code"), "v"), "code")


@query("water_table_kriged")
def water_table_kriged(spark, sf_dir):
    """Ground level less the kriged depth to water: head by cell, with the depth held at 0 or more, whether it was, and how many cells were."""
    w = relation(spark, sf_dir, "wells").where("static_sheet between 0 and 120").select("code", "x", "y", C("static_sheet").alias("s"))
    ground = relation(spark, sf_dir, "grid").select(cell_number().alias("code"), "r", "c", "v")
    return kriging.water_table(w, "s", cells(spark, sf_dir), ground, LAGS).select("r", "c", F.round("head", 6).alias("head"), "clipped", "n_clipped")


@query("regression_kriging")
def regression_kriging(spark, sf_dir):
    """A drift on place and terrain height plus kriged residuals, on the grid."""
    w, targets = wells_on_terrain(spark, sf_dir)
    return kriging.regression_kriging(w, "z", targets, LAGS, features=("x", "y", "v")).select(C("code").alias("cell"), F.round("estimate", 6).alias("estimate"))


DRIFT = ("depth_m", "hours", "x")

_S = {(a, b): f"s{i}{j}" for i, a in enumerate((*DRIFT, "z")) for j, b in enumerate((*DRIFT, "z")) if i <= j}
#: The normal equations of three covariates by determinants.
DRIFT_SQL = f""", m as (select {", ".join(f"avg({c}) as m_{c}" for c in (*DRIFT, "z"))} from wells),
s as (select {", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b})) as {n}" for (a, b), n in _S.items())} from wells, m),
d as (select *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) as det from s),
b as (select *, (s03 * (s11 * s22 - s12 * s12) - s01 * (s13 * s22 - s12 * s23) + s02 * (s13 * s12 - s11 * s23)) / det as b0,
  (s00 * (s13 * s22 - s23 * s12) - s03 * (s01 * s22 - s12 * s02) + s02 * (s01 * s23 - s13 * s02)) / det as b1,
  (s00 * (s11 * s23 - s12 * s13) - s01 * (s01 * s23 - s02 * s13) + s03 * (s01 * s12 - s11 * s02)) / det as b2 from d)
select round(m_z - b0 * m_depth_m - b1 * m_hours - b2 * m_x, 6) as intercept, round(b0 * 1e3, 6) as depth_m, round(b1 * 1e3, 6) as hours, round(b2 * 1e6, 6) as x, round((b0 * s03 + b1 * s13 + b2 * s23) / s33, 6) as r2, 3 as rank, (select count(*) from wells) as n from b, m"""


@query("drift_coefficients", "wells", DRIFT_SQL)
def drift_coefficients(spark, sf_dir):
    """The least-squares drift of z on three covariates (in thousandths and millionths), its R2 and rank."""
    d = drift.least_squares(relation(spark, sf_dir, "wells"), list(DRIFT), "z")
    unit = dict(zip(DRIFT, (1e3, 1e3, 1e6), strict=True))
    row = {"intercept": d.intercept} | {f: b * unit[f] for f, b in zip(DRIFT, d.slopes, strict=True)} | {"r2": d.r2}
    one = spark.createDataFrame([(*row.values(), d.rank, d.n)], ", ".join(f"{k} double" for k in row) + ", rank int, n long")
    return one.select(*[F.round(k, 6).alias(k) for k in row], "rank", "n")


#: What regression kriging has to gain to be adopted, as a share of the RMSE.
GAIN = 0.05


def surfaces_left_out(spark, sf_dir):
    """Estimates of z on every well from the wells of other 10 km blocks' folds."""
    w, _ = wells_on_terrain(spark, sf_dir)
    return kriging.left_out_blocks(models.spatial_folds(w, 10000.0, 5, 42), "z", LAGS, ("x", "y", "v"))


@query("surface_cv")
def surface_cv(spark, sf_dir):
    """RMSE of ordinary and regression kriging by left-out fold."""
    e = lambda c: F.round(F.sqrt(F.avg((C(c) - C("actual")) * (C(c) - C("actual")))), 6)
    return surfaces_left_out(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), e("ok").alias("rmse_ok"), e("rk").alias("rmse_rk"))


@query("surface_gate")
def surface_gate(spark, sf_dir):
    """Over all left-out wells: RMSE of both, what regression kriging gains, and whether it is adopted."""
    e = lambda c: F.sqrt(F.avg((C(c) - C("actual")) * (C(c) - C("actual"))))
    both = surfaces_left_out(spark, sf_dir).agg(F.count("*").alias("n"), e("ok").alias("ok"), e("rk").alias("rk"))
    gain = (C("ok") - C("rk")) / C("ok")
    return both.select("n", F.round("ok", 6).alias("rmse_ok"), F.round("rk", 6).alias("rmse_rk"), F.round(gain, 6).alias("gain"), (gain >= GAIN).alias("adopt"))
