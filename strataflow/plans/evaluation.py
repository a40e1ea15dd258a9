"""Model evaluation: AUC, R2, classes, gates, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.operators import captured, metrics, nugget_intervals, resample, spatial
from strataflow.operators.validation import LEAST_ROWS
from strataflow.plans.registry import query
from strataflow.session import cut

R6 = lambda c: F.round(c, 6).alias(c)


def scores(spark, sf_dir):
    return relation(spark, sf_dir, "scores")


AUC1 = """, cells as (select {k}score as s, sum(case when y = 1 then {w} else 0 end) as pos, sum(case when y = 1 then 0 else {w} end) as neg, count(*) as n from {src} group by all),
run as (select *, sum(neg) over ({part}order by s rows between unbounded preceding and current row) - neg as below from cells)"""


@query("auc_weighted", "scores", AUC1.format(k="", w="w", src="scores", part="") + " select cast(sum(n) as bigint) as n, round(sum(pos), 6) as positives, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from run")
def auc_weighted(spark, sf_dir):
    """Weighted AUC with tied scores counted half."""
    return metrics.auc(scores(spark, sf_dir), "y", "score", "w").select("n", R6("positives"), R6("auc"))


@query("auc_unweighted", "scores", AUC1.format(k="", w="1", src="scores", part="") + " select cast(sum(n) as bigint) as n, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from run")
def auc_unweighted(spark, sf_dir):
    """AUC of all scores."""
    return metrics.auc(scores(spark, sf_dir), "y", "score").select("n", R6("auc"))


@query("running_negatives", "scores", """, cells as (select score, sum(y) as pos, sum(1 - y) as neg from scores group by score)
select score, cast(pos as bigint) as pos, cast(neg as bigint) as neg, cast(sum(neg) over (order by score rows between unbounded preceding and current row) - neg as bigint) as below from cells""")
def running_negatives(spark, sf_dir):
    """Positives, negatives and the negatives below each distinct score."""
    cells = scores(spark, sf_dir).groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return metrics.running_below(cells, "score", "neg").select("score", "pos", "neg", "below")


@query("r2_rmse", "scores", ", m as (select avg(v) as mv from scores) select count(*) as n, round(1 - sum((v - v_hat) * (v - v_hat)) / sum((v - mv) * (v - mv)), 6) as r2, round(sqrt(avg((v - v_hat) * (v - v_hat))), 6) as rmse from scores, m")
def r2_rmse(spark, sf_dir):
    """R2 and RMSE."""
    return metrics.r2_rmse(scores(spark, sf_dir), "v", "v_hat").select("n", R6("r2"), R6("rmse"))


@query("r2_weighted", "scores", ", m as (select sum(w * v) / sum(w) as mv from scores) select count(*) as n, round(1 - sum(w * (v - v_hat) * (v - v_hat)) / sum(w * (v - mv) * (v - mv)), 6) as r2, round(sqrt(sum(w * (v - v_hat) * (v - v_hat)) / sum(w)), 6) as rmse from scores, m")
def r2_weighted(spark, sf_dir):
    """Weighted R2 and RMSE."""
    return metrics.r2_rmse(scores(spark, sf_dir), "v", "v_hat", "w").select("n", R6("r2"), R6("rmse"))


BREAKS = ", b as (select quantile_cont(p, 0.2) as b1, quantile_cont(p, 0.4) as b2, quantile_cont(p, 0.6) as b3, quantile_cont(p, 0.8) as b4 from scores)"
CLASSED = BREAKS + ", classed as (select s.*, 1 + cast(p >= b1 as int) + cast(p >= b2 as int) + cast(p >= b3 as int) + cast(p >= b4 as int) as class from scores s, b)"


def breaks(frame, column="p"):
    return metrics.quantiles(frame, column, [0.2, 0.4, 0.6, 0.8], ["b1", "b2", "b3", "b4"])


def classed(frame, column="p"):
    """Rows with their class 1 to 5: one more than the breaks at or below the value."""
    over = sum((F.col(column) >= F.col(f"b{k}")).cast("int") for k in range(1, 5))
    return frame.crossJoin(F.broadcast(breaks(frame, column))).withColumn("class", F.lit(1) + over).drop("b1", "b2", "b3", "b4")


@query("class_breaks", "scores", BREAKS + " select round(b1, 6) as b1, round(b2, 6) as b2, round(b3, 6) as b3, round(b4, 6) as b4 from b")
def class_breaks(spark, sf_dir):
    """Quintile breaks of the predicted probability."""
    return breaks(scores(spark, sf_dir)).select(*[R6(f"b{k}") for k in range(1, 5)])


RATES = CLASSED + """, rates as (select class, count(*) as n, sum(y) as hits, avg(y) as rate, max(base) as base, max(total) as total from classed, (select avg(y) as base, sum(y) as total from scores) group by class)"""


def rates(frame):
    total = F.broadcast(frame.agg(F.avg("y").alias("base"), F.sum("y").alias("total")))
    return classed(frame).groupBy("class").agg(F.count("*").alias("n"), F.sum("y").alias("hits"), F.avg("y").alias("rate")).crossJoin(total)


@query("class_rates_lift", "scores", RATES + " select class, n, round(rate, 6) as rate, round(rate / base, 6) as lift, round(hits / total, 6) as recall, round(10 / nullif(rate, 0), 6) as wells_per_10_hits from rates")
def class_rates_lift(spark, sf_dir):
    """Rate, lift, recall and wells for ten hits by class."""
    r = rates(scores(spark, sf_dir))
    return r.select("class", "n", R6("rate"), F.round(F.col("rate") / F.col("base"), 6).alias("lift"), F.round(F.col("hits") / F.col("total"), 6).alias("recall"), F.round(10 / F.nullif("rate", F.lit(0.0)), 6).alias("wells_per_10_hits"))


@query("monotonicity", "scores", RATES + ", l as (select rate, lead(rate) over (order by class) as after from rates) select bool_and(rate <= after + 0.02) as monotone, count(after) as n_steps from l")
def monotonicity(spark, sf_dir):
    """Whether rates rise by class, with a tolerance of 0.02."""
    r = rates(scores(spark, sf_dir)).withColumn("after", F.expr("lead(rate) over (order by class)"))
    return r.agg(F.bool_and(F.col("rate") <= F.col("after") + 0.02).alias("monotone"), F.count("after").alias("n_steps"))


SEEDS = AUC1.format(k="seed, ", w="1", src="scores", part="partition by seed ") + ", s as (select seed, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auc from run group by seed)"


def by_seed(frame, score="score"):
    return metrics.auc(frame, "y", score, keys=("seed",))


@query("seed_spread", "scores", SEEDS + " select count(*) as seeds, round(avg(auc), 6) as mean_auc, round(stddev_samp(auc), 6) as sd_auc, round(max(auc), 6) as best from s")
def seed_spread(spark, sf_dir):
    """Mean, sample standard deviation and maximum of the AUC over seeds."""
    return by_seed(scores(spark, sf_dir)).agg(F.count("*").alias("seeds"), F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_samp("auc"), 6).alias("sd_auc"), F.round(F.max("auc"), 6).alias("best"))


CEILING = 0.672
FACTOR = 0.95


@query("acceptance_gate", "scores", SEEDS + f", m as (select avg(auc) as model from s) select round(model, 6) as model, cast({FACTOR} * {CEILING} as double) as bar, model >= {FACTOR} * {CEILING} and model > 0.5 as accepted, round((model - 0.5) / ({CEILING} - 0.5), 6) as captured from m")
def acceptance_gate(spark, sf_dir):
    """Whether the mean AUC reaches its share of the ceiling and beats chance, and the chance-corrected fraction."""
    m = by_seed(scores(spark, sf_dir)).agg(F.avg("auc").alias("m"))
    return m.select(F.round("m", 6).alias("model"), F.lit(FACTOR * CEILING).alias("bar"), ((F.col("m") >= FACTOR * CEILING) & (F.col("m") > 0.5)).alias("accepted"), F.round((F.col("m") - 0.5) / (CEILING - 0.5), 6).alias("captured"))


@query("verdict_band", "scores", SEEDS + " select seed, round(auc, 6) as auc, case when auc >= 0.65 then 'strong' when auc >= 0.55 then 'partial' else 'none' end as verdict from s")
def verdict_band(spark, sf_dir):
    """A verdict for each seed's AUC."""
    auc = F.col("auc")
    return by_seed(scores(spark, sf_dir)).select("seed", R6("auc"), F.when(auc >= 0.65, "strong").when(auc >= 0.55, "partial").otherwise("none").alias("verdict"))


@query("captured_fraction", "scores", AUC1.format(k="", w="1", src="scores", part="") + ", a as (select sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auc from run), r as (select 1 - sum((v - v_hat) * (v - v_hat)) / sum((v - mv) * (v - mv)) as r2 from scores, (select avg(v) as mv from scores)) select round(auc, 6) as auc, round((auc - 0.5) / (0.672 - 0.5), 6) as auc_fraction, round(r2, 6) as r2, round(r2 / (1 - 0.25), 6) as r2_fraction from a, r")
def captured_fraction(spark, sf_dir):
    """How much of the AUC ceiling and of the reachable R2 the predictions capture."""
    s = scores(spark, sf_dir)
    both = metrics.auc(s, "y", "score").select("auc").crossJoin(metrics.r2_rmse(s, "v", "v_hat").select("r2"))
    return both.select(R6("auc"), F.round((F.col("auc") - 0.5) / (CEILING - 0.5), 6).alias("auc_fraction"), R6("r2"), F.round(F.col("r2") / (1 - 0.25), 6).alias("r2_fraction"))


@query("rmse_compare_gate", "scores", ", e as (select sqrt(avg((v - v_hat) * (v - v_hat))) as base, sqrt(avg((v - (v + v_hat) / 2) * (v - (v + v_hat) / 2))) as new from scores) select round(base, 6) as rmse_base, round(new, 6) as rmse_new, round((base - new) / base, 6) as gain, (base - new) / base >= 0.05 as adopt from e")
def rmse_compare_gate(spark, sf_dir):
    """Adopts the second estimate if it lowers the RMSE by 5 %."""
    e1, e2 = F.col("v") - F.col("v_hat"), F.col("v") - (F.col("v") + F.col("v_hat")) / 2
    e = scores(spark, sf_dir).agg(F.sqrt(F.avg(e1 * e1)).alias("a"), F.sqrt(F.avg(e2 * e2)).alias("b"))
    gain = (F.col("a") - F.col("b")) / F.col("a")
    return e.select(F.round("a", 6).alias("rmse_base"), F.round("b", 6).alias("rmse_new"), F.round(gain, 6).alias("gain"), (gain >= 0.05).alias("adopt"))


@query("model_disagreement", "scores", " select round(avg(abs(p - p2)), 6) as mean_gap, round(max(abs(p - p2)), 6) as max_gap, round(avg(case when abs(p - p2) > 0.2 then 1.0 else 0.0 end), 6) as share_over_02 from scores")
def model_disagreement(spark, sf_dir):
    """Absolute difference of two models' probabilities."""
    gap = F.abs(F.col("p") - F.col("p2"))
    return scores(spark, sf_dir).agg(F.round(F.avg(gap), 6).alias("mean_gap"), F.round(F.max(gap), 6).alias("max_gap"), F.round(F.avg((gap > 0.2).cast("int")), 6).alias("share_over_02"))


FOLDS = """, parts as (select code, x, y, z, code % 5 as fold from wells), pairs as (select t.code as a, t.fold, min(sqrt((t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y))) as d
  from parts t join parts r on t.fold <> r.fold group by t.code, t.fold)"""


def fold_distances(spark, sf_dir):
    """Distance of each well to the nearest well of another fold."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", (F.col("code") % 5).alias("fold"))
    near = spatial.nearest(w, w, 1, carry=("fold",), differ="fold")
    return near.select(F.col("a").alias("code"), F.col("a_fold").alias("fold"), "d")


@query("test_train_distance", "wells", FOLDS + """ select fold, count(*) as n, round(min(d), 4) as d_min, round(quantile_cont(d, 0.1), 4) as p10, round(quantile_cont(d, 0.5), 4) as median, round(quantile_cont(d, 0.9), 4) as p90, round(max(d), 4) as d_max,
round(avg(case when d < 250 then 1.0 else 0.0 end), 6) as below_250, round(avg(case when d < 1000 then 1.0 else 0.0 end), 6) as below_1km from pairs group by fold""")
def test_train_distance(spark, sf_dir):
    """Distribution of test-to-train distances by fold."""
    far = cut(fold_distances(spark, sf_dir).select(F.col("fold").cast("long").alias("fold"), "d"))
    q = metrics.quantiles(far, "d", [0.1, 0.5, 0.9], ["p10", "median", "p90"], ("fold",)).select("fold", *[F.round(c, 4).alias(c) for c in ("p10", "median", "p90")])
    return far.groupBy("fold").agg(
        F.count("*").alias("n"), F.round(F.min("d"), 4).alias("d_min"), F.round(F.max("d"), 4).alias("d_max"),
        F.round(F.avg((F.col("d") < 250).cast("int")), 6).alias("below_250"), F.round(F.avg((F.col("d") < 1000).cast("int")), 6).alias("below_1km"),
    ).join(q, "fold")


@query("buffer_eval", "wells", FOLDS + """, t as (select quantile_cont(z, 0.75) as q from wells), far as (select w.code, case when z >= q then 1 else 0 end as y, w.depth_m as score from pairs p join wells w on w.code = p.a, t where d >= 1000),
cells as (select score as s, sum(y) as pos, sum(1 - y) as neg from far group by score), run as (select *, sum(neg) over (order by s rows between unbounded preceding and current row) - neg as below from cells)
select (select count(*) from wells) - n as n_removed, n, valid, case when valid then auc end as auc from (select cast(coalesce(sum(pos + neg), 0) as bigint) as n,
  round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) as auc, coalesce(sum(pos + neg) >= 50 and sum(pos) * sum(neg) > 0, false) as valid from run)""")
def buffer_eval(spark, sf_dir):
    """AUC on wells at least 1 km away from the other folds, with the training side unchanged; none where fewer than 50 wells or one class are left."""
    w = relation(spark, sf_dir, "wells").select("code", "z", F.col("depth_m").alias("score"))
    w = w.crossJoin(F.broadcast(metrics.quantiles(w, "z", [0.75], ["q"]))).withColumn("y", (F.col("z") >= F.col("q")).cast("int"))
    far = w.join(fold_distances(spark, sf_dir).where("d >= 1000").select("code"), "code")
    total = w.agg(F.count("*").alias("total"))
    n, valid = F.coalesce("n", F.lit(0)), F.coalesce((F.col("n") >= LEAST_ROWS) & F.col("auc").isNotNull(), F.lit(False))
    return metrics.auc(far, "y", "score").crossJoin(total).select((F.col("total") - n).alias("n_removed"), n.alias("n"), valid.alias("valid"), F.when(valid, F.round("auc", 6)).alias("auc"))


REPS = 20
WEIGHTS = ", reps as (select unnest(range(0, 20)) as rep), wt as (select rep, code, cast((code * 31 + rep * 17 + code * rep) % 4 as double) as c from {t}, reps)"


@query("bootstrap_auc_fixed_w", "scores", WEIGHTS.format(t="scores") + """, cells as (select rep, score as s, sum(c * y) as pos, sum(c * (1 - y)) as neg from scores join wt using (code) group by rep, score),
run as (select *, sum(neg) over (partition by rep order by s rows between unbounded preceding and current row) - neg as below from cells),
a as (select rep, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auc from run group by rep)
select count(*) as reps, round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high from a""")
def bootstrap_auc_fixed_w(spark, sf_dir):
    """Interval of the AUC over repetitions with given weights."""
    ci = resample.interval(resample.auc_by_repetition(scores(spark, sf_dir), "y", "score", "code", resample.GivenDraw(), REPS), "auc")
    return ci.select(F.col("n_valid").alias("reps"), R6("low"), R6("high"))


@query("bootstrap_nugget_fixed_w", "wells", WEIGHTS.format(t="wells") + """, pairs as (select a.code as a, b.code as b, (a.z - b.z) * (a.z - b.z) / 2 as g from wells a join wells b on a.code < b.code and abs(a.x - b.x) <= 1000 and abs(a.y - b.y) <= 1000
  and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1000000),
g as (select wa.rep, sum(wa.c * wb.c * g) / sum(wa.c * wb.c) as gamma from pairs join wt wa on wa.code = a join wt wb on wb.code = b and wb.rep = wa.rep group by wa.rep),
s as (select rep, sum(c * z * z) / sum(c) - pow(sum(c * z) / sum(c), 2) as sill from wells join wt using (code) group by rep)
select count(*) as reps, round(quantile_cont(least(1, gamma / sill), 0.025), 6) as low, round(quantile_cont(least(1, gamma / sill), 0.975), 6) as high from g join s using (rep)""")
def bootstrap_nugget_fixed_w(spark, sf_dir):
    """Interval of the nugget with wells drawn by given weights: a pair counts as often as both ends do, the variance is estimated anew."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    middle = w.agg(F.avg("z").alias("mean"))
    w = cut(w.crossJoin(F.broadcast(middle)).withColumn("z", F.col("z") - F.col("mean")).drop("mean"))
    # pairs at one place count here
    gamma = nugget_intervals.pair_sums(w, "z", (-1, 1000), REPS, nugget_intervals.Given()).select("rep", (F.col("wg") / F.nullif("w", F.lit(0.0))).alias("gamma"))
    own = nugget_intervals.sills(w, "z", REPS, nugget_intervals.Given())
    ci = resample.interval(gamma.join(own, "rep").withColumn("nugget", F.least(F.lit(1.0), F.col("gamma") / F.col("sill"))), "nugget")
    return ci.select(F.col("n_valid").alias("reps"), R6("low"), R6("high"))


@query("block_bootstrap_ratio")
def block_bootstrap_ratio(spark, sf_dir):
    """Interval of the ratio of two models' chance-corrected AUCs, with blocks drawn jointly for both."""
    s = scores(spark, sf_dir).select("block", "y", "p", "p2")
    s = s.join(resample.weights(s, "block", 2000, 7), "block")
    first = metrics.auc(s, "y", "p", "w", keys=("rep",)).select("rep", "auc")
    second = metrics.auc(s, "y", "p2", "w", keys=("rep",)).select("rep", F.col("auc").alias("auc2"))
    ratio = first.join(second, "rep").withColumn("ratio", (F.col("auc") - 0.5) / F.nullif(F.col("auc2") - 0.5, F.lit(0.0)))
    return resample.interval(ratio, "ratio")


@query("bootstrap_mean")
def bootstrap_mean(spark, sf_dir):
    """Interval of the mean of v, rows drawn with Poisson weights."""
    s = scores(spark, sf_dir).select("code", "v")
    w = s.join(resample.weights(s, "code", 2000, 1), "code")
    return resample.interval(w.groupBy("rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean")), "mean")


@query("bootstrap_auc_pairs")
def bootstrap_auc_pairs(spark, sf_dir):
    """Interval of the AUC, rows drawn with Poisson weights."""
    s = scores(spark, sf_dir).select("code", "y", "score")
    w = s.join(resample.weights(s, "code", 2000, 2), "code")
    return resample.interval(metrics.auc(w, "y", "score", "w", keys=("rep",)), "auc")


@query("ci_floor", "scores", AUC1.format(k="block, ", w="1", src="scores", part="partition by block ") + """, a as (select block, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc, sum(n) as n from run group by block)
select count(*) as n_blocks, count(auc) as n_valid, case when count(auc) >= 10 then round(quantile_cont(auc, 0.025), 6) end as low, case when count(auc) >= 10 then round(quantile_cont(auc, 0.975), 6) end as high from a""")
def ci_floor(spark, sf_dir):
    """Spread of the AUC over blocks, reported only with ten valid blocks or more."""
    a = metrics.auc(scores(spark, sf_dir), "y", "score", keys=("block",))
    ci = resample.interval(a, "auc")
    return a.agg(F.count("*").alias("n_blocks")).crossJoin(ci).select("n_blocks", "n_valid", R6("low"), R6("high"))


#: Neighbours count within RADIUS metres, pairs for the nugget within LAG; blocks are of BLOCK_M.
RADIUS, LAG, BLOCK_M = 2000.0, 1000.0, 10000.0

CAPTURED_SQL = f""", t as (select quantile_cont(z, 0.75) as q from wells),
pts as (select w.code, w.x, w.y, w.z, case when w.z >= q then 1 else 0 end as y1, cast(floor(w.x / {BLOCK_M}) * 1000 + floor(w.y / {BLOCK_M}) as bigint) as block, s.p, s.p2 from wells w join scores s on s.code = w.code, t),
pairs as (select a.code as a, b.code as b, a.z as az, b.z as bz, a.block as ab, b.block as bb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from pts a join pts b on a.code <> b.code and abs(a.x - b.x) <= {RADIUS} and abs(a.y - b.y) <= {RADIUS}),
ranked as (select *, row_number() over (partition by a order by d, b) as rank from pairs where d <= {RADIUS}),
near as (select a as code, k, round(sum(bz / greatest(d, 1)) / sum(1 / greatest(d, 1)), 9) as score from ranked, (values (1), (5)) v(k) where rank <= k group by a, k),
blocks as (select distinct block from pts), reps as (select unnest(range(0, 20)) as rep),
wt as (select rep, block, cast((block * 31 + rep * 17 + block * rep) % 4 as double) as c from blocks, reps union all select -1, block, 1.0 from blocks),
own as (select pts.*, rep, c, pts.code in (select code from near) as inside from pts join wt using (block) where c > 0),
rows_ as (select rep, 'k' || k as what, y1, score, c from own join near using (code) union all select rep, 'A|0', y1, p, c from own union all select rep, 'A|1', y1, p2, c from own
  union all select rep, 'B|0', y1, p, c from own where inside union all select rep, 'B|1', y1, p2, c from own where inside),
cells as (select rep, what, score, sum(c * y1) as pos, sum(c * (1 - y1)) as neg from rows_ group by rep, what, score),
run as (select *, sum(neg) over (partition by rep, what order by score rows between unbounded preceding and current row) - neg as below from cells),
aucs as (select rep, what, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from run group by rep, what),
bench as (select rep, cast(substr(what, 2) as int) as k, auc as bench from aucs where what like 'k%'), model as (select rep, substr(what, 1, 1) as population, avg(auc) as auc from aucs where what not like 'k%' group by 1, 2),
values_ as (select rep, seed, c, z, z * 0.6 + 0.5 * case seed when 0 then p else p2 end as v from own, (values (0), (1)) s(seed)),
means as (select rep, seed, sum(c * z) / sum(c) as mz from values_ group by rep, seed),
r2 as (select rep, avg(r2) as r2 from (select rep, seed, 1 - sum(c * (z - v) * (z - v)) / sum(c * (z - mz) * (z - mz)) as r2 from values_ join means using (rep, seed) group by rep, seed) group by rep),
gamma as (select wa.rep, sum(wa.c * wb.c * (az - bz) * (az - bz) / 2) / sum(wa.c * wb.c) as gamma from pairs join wt wa on wa.block = ab and wa.c > 0 join wt wb on wb.block = bb and wb.rep = wa.rep and wb.c > 0 where a < b and d <= {LAG} group by wa.rep),
sill as (select rep, sum(c * z * z) / sum(c) - pow(sum(c * z) / sum(c), 2) as sill from own group by rep),
every_ as (select 'auc' as ratio, population, k, rep, case when bench > 0.5 then (auc - 0.5) / (bench - 0.5) end as v from model join bench using (rep)
  union all select 'r2', 'A', null, rep, case when sill > 0 and 1 - gamma / sill > 0 then r2 / (1 - gamma / sill) end from r2 left join gamma using (rep) left join sill using (rep))
select ratio, population, k, round(max(v) filter (rep = -1), 6) as point, case when count(v) filter (rep >= 0) >= 10 then round(quantile_cont(v, 0.025) filter (rep >= 0), 6) end as low,
  case when count(v) filter (rep >= 0) >= 10 then round(quantile_cont(v, 0.975) filter (rep >= 0), 6) end as high, round(avg(cast(v > 1 as int)) filter (rep >= 0 and v is not null), 6) as above, count(v) filter (rep >= 0) as n_valid
from every_ group by ratio, population, k having count(*) filter (rep = -1) > 0"""


def block_weights(points, repetitions=REPS):
    """Given weights of blocks, the same in any engine."""
    return resample.fixed_weights(points.select(F.col("block").alias("code")).distinct(), repetitions).withColumnRenamed("code", "block")


def population(spark, sf_dir):
    """Wells with target and block, and two seeds' predictions of them."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    w = w.crossJoin(F.broadcast(metrics.quantiles(w, "z", [0.75], ["q"]))).withColumn("y1", (F.col("z") >= F.col("q")).cast("int")).drop("q")
    w = cut(w.withColumn("block", F.floor(F.col("x") / BLOCK_M) * 1000 + F.floor(F.col("y") / BLOCK_M)))
    s = w.join(relation(spark, sf_dir, "scores").select("code", "p", "p2"), "code")
    seed = F.explode(F.array(F.struct(F.lit(0).alias("seed"), F.col("p").alias("p")), F.struct(F.lit(1).alias("seed"), F.col("p2").alias("p")))).alias("s")
    return w, s.select("code", "z", seed).select("code", "s.seed", "s.p", (F.col("z") * 0.6 + 0.5 * F.col("s.p")).alias("v"))


@query("captured_populations", "wells scores", CAPTURED_SQL)
def captured_populations(spark, sf_dir):
    """Captured fraction of the neighbours' AUC and of the reachable R2, for all wells and for those with a neighbour, with intervals over blocks."""
    w, predictions = population(spark, sf_dir)
    got = captured.captured(w, predictions, resample.GivenDraw(), REPS, RADIUS, LAG)
    return got.select("ratio", "population", "k", R6("point"), R6("low"), R6("high"), R6("above"), "n_valid")


@query("captured_populations_drawn")
def captured_populations_drawn(spark, sf_dir, repetitions=2000):
    """The same with blocks drawn by Poisson weights."""
    w, predictions = population(spark, sf_dir)
    return captured.captured(w, predictions, resample.PoissonDraw(20), repetitions, RADIUS, LAG)


BLOCKS = ", reps as (select unnest(range(0, 20)) as rep), wt as (select rep, block, cast((block * 31 + rep * 17 + block * rep) % 4 as double) as c from (select distinct block from scores), reps)"


@query("block_bootstrap_auc", "scores", BLOCKS + """, cells as (select rep, score as s, sum(c * y) as pos, sum(c * (1 - y)) as neg from scores join wt using (block) where c > 0 group by rep, score),
run as (select *, sum(neg) over (partition by rep order by s rows between unbounded preceding and current row) - neg as below from cells),
a as (select rep, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from run group by rep)
select count(auc) as reps, case when count(auc) >= 10 then round(quantile_cont(auc, 0.025), 6) end as low, case when count(auc) >= 10 then round(quantile_cont(auc, 0.975), 6) end as high from a""")
def block_bootstrap_auc(spark, sf_dir):
    """Interval of the AUC with whole blocks drawn by given weights."""
    s = scores(spark, sf_dir)
    drawn = s.join(block_weights(s).where("c > 0"), "block")
    return resample.interval(metrics.auc(drawn, "y", "score", "c", keys=("rep",)), "auc").select(F.col("n_valid").alias("reps"), R6("low"), R6("high"))


@query("block_bootstrap_rates", "scores", CLASSED + BLOCKS + """, r as (select rep, class, sum(c * y) / sum(c) as rate from classed join wt using (block) where c > 0 group by rep, class),
o as (select class, count(*) as n, round(avg(y), 6) as rate from classed group by class)
select o.class, n, o.rate, count(r.rate) as reps, case when count(r.rate) >= 10 then round(quantile_cont(r.rate, 0.025), 6) end as low, case when count(r.rate) >= 10 then round(quantile_cont(r.rate, 0.975), 6) end as high from o left join r on r.class = o.class group by o.class, n, o.rate""")
def block_bootstrap_rates(spark, sf_dir):
    """Rate of each class with its interval, whole blocks drawn by given weights; classes stay as they are."""
    s = cut(classed(scores(spark, sf_dir)).select("block", "class", "y"))
    drawn = s.join(block_weights(s).where("c > 0"), "block").groupBy("rep", "class").agg((F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("v"))
    ci = resample.interval(drawn, "v", ("class",))
    own = s.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))
    return own.join(ci, "class", "left").select("class", "n", "rate", F.coalesce("n_valid", F.lit(0)).alias("reps"), R6("low"), R6("high"))
