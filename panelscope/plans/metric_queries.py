"""Registered queries: evaluation metrics of scored rows and loss predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import metrics as m
from . import oracles as o
from . import views as v
from .panel_queries import _r, r6
from .registry import query

T = 0.3  # decision threshold of the registered queries

HIST = f"""{o.SCORED}, h AS (SELECT p, count(*)::BIGINT n, sum(y)::BIGINT pos FROM scored GROUP BY 1),
tot AS (SELECT sum(pos)::DOUBLE tp_all, sum(n-pos)::DOUBLE fp_all, sum(n)::DOUBLE n_all FROM h),
c AS (SELECT p, n, pos, n-pos neg, (sum(pos) OVER (ORDER BY p DESC))::BIGINT tp, (sum(n-pos) OVER (ORDER BY p DESC))::BIGINT fp FROM h)"""

CONF = f"""{o.SCORED}, k AS (SELECT count(*) FILTER (p>=0.3::DOUBLE AND y=1) tp, count(*) FILTER (p>=0.3::DOUBLE AND y=0) fp,
  count(*) FILTER (p<0.3::DOUBLE AND y=1) fn, count(*) FILTER (p<0.3::DOUBLE AND y=0) tn FROM scored),
d AS (SELECT tp::DOUBLE tp, fp::DOUBLE fp, fn::DOUBLE fn, tn::DOUBLE tn FROM k),
pr AS (SELECT *, CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END pre, CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END rec,
  CASE WHEN tn+fp=0 THEN 0 ELSE tn/(tn+fp) END spe FROM d)"""


def _hist(spark, folder, p="p"):
    return m.score_histogram(v.scored(spark, folder), p=p)


@query("score_histogram", f"WITH {HIST} SELECT p, n, pos FROM h")
def score_histogram_query(spark, folder):
    return _hist(spark, folder)


@query("cumulative_confusion", f"WITH {HIST} SELECT p, tp, fp FROM c")
def cumulative_confusion_query(spark, folder):
    return m.cumulative_confusion(_hist(spark, folder)).select("p", "tp", "fp")


@query("confusion_counts", f"WITH {CONF} SELECT tp, fp, fn, tn FROM k")
def confusion_query(spark, folder):
    return m.confusion_counts(_hist(spark, folder), T)


@query("threshold_metrics", f"""WITH {CONF} SELECT {r6('(tp+tn)/(tp+fp+fn+tn)')} accuracy, {r6('pre')} "precision", {r6('rec')} recall,
  {r6('spe')} specificity, {r6('(rec+spe)/2')} balanced_accuracy FROM pr""")
def threshold_metrics_query(spark, folder):
    return m.threshold_metrics(_hist(spark, folder), T).select(*_r("accuracy", "precision", "recall", "specificity", "balanced_accuracy"))


@query("f1_f2", f"""WITH {CONF} SELECT {r6('CASE WHEN pre+rec=0 THEN 0 ELSE 2*pre*rec/(pre+rec) END')} f1_score,
  {r6('CASE WHEN 4*pre+rec=0 THEN 0 ELSE 5*pre*rec/(4*pre+rec) END')} f2_score FROM pr""")
def f1_f2_query(spark, folder):
    return m.threshold_metrics(_hist(spark, folder), T).select(*_r("f1_score", "f2_score"))


@query("mcc", f"""WITH {CONF} SELECT {r6('CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)=0 THEN 0 ELSE (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END')} mcc FROM d""")
def mcc_query(spark, folder):
    return m.threshold_metrics(_hist(spark, folder), T).select(*_r("mcc"))


@query("false_discovery_rate", f"WITH {CONF} SELECT {r6('CASE WHEN tp+fp=0 THEN 0 ELSE fp/(tp+fp) END')} false_discovery_rate FROM d")
def fdr_query(spark, folder):
    return m.threshold_metrics(_hist(spark, folder), T).select(*_r("false_discovery_rate"))


@query("roc_curve", f"WITH {HIST} SELECT p threshold, {r6('fp/fp_all')} fpr, {r6('tp/tp_all')} tpr FROM c, tot")
def roc_curve_query(spark, folder):
    return m.roc_curve(_hist(spark, folder)).select("threshold", *_r("fpr", "tpr"))


@query("roc_auc", f"""WITH {o.SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE rk FROM scored),
  s AS (SELECT sum(rk) FILTER (y=1) sr, count(*) FILTER (y=1)::DOUBLE a, count(*) FILTER (y=0)::DOUBLE b FROM r)
  SELECT {r6('(sr-a*(a+1)/2)/(a*b)')} roc_auc FROM s""")
def roc_auc_query(spark, folder):
    return m.roc_auc(_hist(spark, folder)).select(*_r("roc_auc"))


@query("pr_curve", f"""WITH {HIST} SELECT p threshold, {r6('tp::DOUBLE/(tp+fp)')} "precision", {r6('tp/tp_all')} recall FROM c, tot
  UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM tot""")
def pr_curve_query(spark, folder):
    return m.pr_curve(_hist(spark, folder)).select("threshold", *_r("precision", "recall"))


_CURVE = f"""{HIST}, pts AS (SELECT p, tp::DOUBLE/(tp+fp) pre, tp/tp_all rec FROM c, tot),
seg AS (SELECT p, pre, rec, lag(pre,1,1.0::DOUBLE) OVER (ORDER BY p DESC) pre0, lag(rec,1,0.0::DOUBLE) OVER (ORDER BY p DESC) rec0 FROM pts)"""


@query("pr_auc", f"WITH {_CURVE} SELECT {r6('sum((rec-rec0)*(pre+pre0)/2)')} pr_auc FROM seg")
def pr_auc_query(spark, folder):
    return m.curve_areas(_hist(spark, folder)).select(*_r("pr_auc"))


@query("average_precision", f"WITH {_CURVE} SELECT {r6('sum((rec-rec0)*pre)')} average_precision FROM seg")
def average_precision_query(spark, folder):
    return m.curve_areas(_hist(spark, folder)).select(*_r("average_precision"))


@query("curve_areas", f"""WITH {_CURVE}, a AS (SELECT sum((rec-rec0)*(pre+pre0)/2) pr_auc, sum((rec-rec0)*pre) average_precision FROM seg),
  b AS (SELECT sum(neg*(tp-pos/2.0::DOUBLE))/any_value(tp_all*fp_all) roc_auc FROM c, tot)
  SELECT {r6('roc_auc')} roc_auc, {r6('pr_auc')} pr_auc, {r6('average_precision')} average_precision FROM a, b""")
def curve_areas_query(spark, folder):
    return m.curve_areas(_hist(spark, folder)).select(*_r("roc_auc", "pr_auc", "average_precision"))


@query("brier", f"""WITH {o.SCORED}, b AS (SELECT avg((p-y)*(p-y)) b, avg(y)*(1-avg(y)) b0 FROM scored)
  SELECT {r6('b')} brier, {r6('b0')} brier_null, {r6('1-b/b0')} brier_skill,
  CASE WHEN 1-b/b0<0.10 THEN 'weak (<0.10)' WHEN 1-b/b0<0.25 THEN 'marginal (0.10-0.25)' ELSE 'skillful (>=0.25)' END band FROM b""")
def brier_query(spark, folder):
    return m.brier(_hist(spark, folder)).select("band", *_r("brier", "brier_null", "brier_skill"))


_EDGES = m.bin_edges(10)
_ECE_BIN = "CASE " + " ".join(f"WHEN p>={a!r}::DOUBLE AND p<{b!r}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END"
_REL_BIN = "CASE " + " ".join(f"WHEN p<={b!r}::DOUBLE THEN {i}" for i, b in enumerate(_EDGES[1:])) + " END"


@query("ece", f"""WITH {o.SCORED}, b AS (SELECT {_ECE_BIN} bin, count(*) n, avg(p) ap, avg(y) ay FROM scored GROUP BY 1)
  SELECT {r6('sum(CASE WHEN bin IS NULL THEN 0 ELSE n*abs(ap-ay) END)/sum(n)')} ece FROM b""")
def ece_query(spark, folder):
    return m.ece(_hist(spark, folder)).select(*_r("ece"))


@query("reliability_curve", f"""WITH {o.SCORED} SELECT {_REL_BIN}::INT bin, count(*)::BIGINT n, {r6('avg(p)')} mean_predicted,
  {r6('avg(y)')} fraction_positive FROM scored GROUP BY 1""")
def reliability_query(spark, folder):
    return m.reliability_curve(_hist(spark, folder)).select("bin", "n", *_r("mean_predicted", "fraction_positive"))


@query("optimal_threshold", f"""WITH {HIST}, pts AS (SELECT p, tp::DOUBLE/(tp+fp) pre, tp/tp_all rec FROM c, tot)
  SELECT p threshold, {r6('pre')} "precision", {r6('rec')} recall FROM pts WHERE rec>=0.75 ORDER BY pre DESC, p LIMIT 1""")
def optimal_threshold_query(spark, folder):
    return m.optimal_threshold(_hist(spark, folder)).select("threshold", *_r("precision", "recall"))


def _grid(values) -> str:
    return "thr AS (SELECT unnest([" + ",".join(f"{t!r}::DOUBLE" for t in values) + "]) t)"


_DCA = f"""{HIST}, {_grid(m.decision_thresholds())},
  q AS (SELECT t, coalesce(sum(pos) FILTER (p>=t),0)::DOUBLE tp, coalesce(sum(n-pos) FILTER (p>=t),0)::DOUBLE fp FROM thr, h GROUP BY 1),
  nb AS (SELECT t, {r6('tp/n_all - fp/n_all*(t/(1-t))')} model, {r6('tp_all/n_all-(1-tp_all/n_all)*(t/(1-t))')} treat_all,
  round(tp_all/n_all,4) prevalence FROM q, tot)"""


@query("decision_curve", f"""WITH {_DCA} SELECT round(t,2) threshold, model model_net_benefit, treat_all, 0.0::DOUBLE treat_none, prevalence,
  model>treat_all AND model>0 is_useful FROM nb""")
def decision_curve_query(spark, folder):
    curve = m.decision_curve(_hist(spark, folder))
    return curve.select(
        F.round("threshold", 2).alias("threshold"), *_r("model_net_benefit", "treat_all"), "treat_none", "prevalence", "is_useful"
    )


@query("useful_threshold_range", f"""WITH {_DCA} SELECT round(min(t) FILTER (model>treat_all AND model>0),2) min_threshold,
  round(max(t) FILTER (model>treat_all AND model>0),2) max_threshold, count(*) FILTER (model>treat_all AND model>0) n_thresholds,
  max(prevalence) prevalence FROM nb""")
def useful_range_query(spark, folder):
    return m.useful_range(m.decision_curve(_hist(spark, folder)))


@query("cost_curve", f"""WITH {HIST}, {_grid(m.cost_thresholds())},
  q AS (SELECT t, round((coalesce(sum(n-pos) FILTER (p>=t),0)+coalesce(sum(pos) FILTER (p<t),0)*100.0::DOUBLE)/sum(n),4) expected_cost FROM thr, h GROUP BY 1)
  SELECT round(t,2) threshold, expected_cost, row_number() OVER (ORDER BY expected_cost, t)=1 is_optimal FROM q""")
def cost_curve_query(spark, folder):
    return m.cost_curve(_hist(spark, folder)).withColumn("threshold", F.round("threshold", 2))


@query("regression_metrics", f"""WITH {o.LINE_LOSSES} SELECT count(*) n, {r6('avg(abs(y-y_hat))', 4)} mae, {r6('sqrt(avg((y-y_hat)*(y-y_hat)))', 4)} rmse,
  {r6('1-sum((y-y_hat)*(y-y_hat))/(count(*)*var_pop(y))')} r_squared,
  {r6('100*median(CASE WHEN y>0.1 THEN abs((y-y_hat)/y) END)', 4)} mdape, {r6('avg(y)', 4)} mean_y, {r6('stddev_pop(y)', 4)} std_y FROM line_losses""")
def regression_metrics_query(spark, folder):
    out = m.regression_metrics(v.line_losses(spark, folder))
    return out.select("n", *_r("r_squared"), *_r("mae", "rmse", "mdape", "mean_y", "std_y", digits=4))


_MODELS = {"steep": "p", "flat": "p_low", "logit": "p_logit"}


def _models(spark, folder):
    scored = v.scored(spark, folder)
    pairs = F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).alias("p")) for k, c in _MODELS.items()])
    long = scored.select("y", F.explode(pairs).alias("s")).select("y", "s.*")
    return m.score_histogram(long, by=["model"])


_MODEL_SQL = f"""{o.SCORED}, long AS (""" + " UNION ALL ".join(f"SELECT '{k}' model, y, {c} p FROM scored" for k, c in _MODELS.items()) + f"""),
h AS (SELECT model, p, count(*)::BIGINT n, sum(y)::BIGINT pos FROM long GROUP BY 1,2),
t AS (SELECT model, sum(pos)::DOUBLE a, sum(n-pos)::DOUBLE b FROM h GROUP BY 1),
c AS (SELECT model, p, n, pos, n-pos neg, sum(pos) OVER w::DOUBLE tp, sum(n-pos) OVER w::DOUBLE fp FROM h WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
pts AS (SELECT model, p, tp/(tp+fp) pre, tp/a rec, fp/b fpr FROM c JOIN t USING (model)),
seg AS (SELECT *, lag(pre,1,1.0::DOUBLE) OVER w pre0, lag(rec,1,0.0::DOUBLE) OVER w rec0, lag(fpr,1,0.0::DOUBLE) OVER w fpr0 FROM pts WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
area AS (SELECT model, sum((rec-rec0)*(pre+pre0)/2) pr_auc, sum((fpr-fpr0)*(rec+rec0)/2) roc_auc FROM seg GROUP BY 1),
conf AS (SELECT model, count(*) FILTER (p>=0.3::DOUBLE AND y=1)::DOUBLE tp, count(*) FILTER (p>=0.3::DOUBLE AND y=0)::DOUBLE fp,
  count(*) FILTER (p<0.3::DOUBLE AND y=1)::DOUBLE fn, avg((p-y)*(p-y)) brier FROM long GROUP BY 1),
best AS (SELECT CASE WHEN abs((SELECT pr_auc FROM area WHERE model='steep')-(SELECT pr_auc FROM area WHERE model='flat'))<=0.01 THEN 'steep'
  ELSE (SELECT model FROM area ORDER BY pr_auc DESC, model DESC LIMIT 1) END w)"""


@query("model_comparison", f"""WITH {_MODEL_SQL} SELECT model, {r6('roc_auc')} roc_auc, {r6('pr_auc')} pr_auc, {r6('tp/(tp+fn)')} recall,
  {r6('CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END')} "precision", {r6('2*tp/(2*tp+fp+fn)')} f1_score, {r6('brier')} brier_score, model=w is_winner
  FROM area JOIN conf USING (model), best""")
def model_comparison_query(spark, folder):
    report = m.classification_report(_models(spark, folder), T, ["model"])
    picked = m.select_model(report, preferred="steep", rival="flat")
    return picked.select("model", "is_winner", *_r("roc_auc", "pr_auc", "recall", "precision", "f1_score", "brier_score"))


@query("calibration_comparison", f"""WITH {o.SCORED}, l AS (SELECT 'o' v, y, p FROM scored UNION ALL SELECT 'c', y, p_low FROM scored),
  b AS (SELECT v, {_ECE_BIN} bin, count(*) n, avg(p) ap, avg(y) ay FROM l GROUP BY 1,2),
  e AS (SELECT v, sum(CASE WHEN bin IS NULL THEN 0 ELSE n*abs(ap-ay) END)/sum(n) ece FROM b GROUP BY 1),
  r AS (SELECT v, avg((p-y)*(p-y)) brier FROM l GROUP BY 1),
  w AS (SELECT max(brier) FILTER (v='o') bo, max(brier) FILTER (v='c') bc, max(ece) FILTER (v='o') eo, max(ece) FILTER (v='c') ec FROM e JOIN r USING (v))
  SELECT {r6('bo')} brier_original, {r6('bc')} brier_calibrated, {r6('eo')} ece_original, {r6('ec')} ece_calibrated,
  {r6('bo-bc')} brier_improvement, {r6('eo-ec')} ece_improvement FROM w""")
def calibration_comparison_query(spark, folder):
    out = m.calibration_comparison(v.scored(spark, folder), "y", "p", "p_low")
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])
