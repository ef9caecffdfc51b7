"""Registered queries: tests, spatial statistics, sensitivity and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import hypothesis as hyp
from ..operators import permute, spatial
from ..operators import uncertainty as unc
from ..schema import COMPONENTS
from ..sources.durable import count_rows, durable
from . import oracles as o
from . import views as v
from .panel_queries import MODAL, _r, r6
from .registry import query

UNIT_RISK = f"{o.INDEXED}, m AS (SELECT District, Region, avg(Disaster_Risk_Score) x FROM indexed GROUP BY 1,2)"


def _unit_risk(spark, folder):
    return agg.unit_means(v.indexed(spark, folder), ["Disaster_Risk_Score"], extra=["Region"])


_ANOVA = """g AS (SELECT Region, count(*)::DOUBLE n, avg(x) mu, var_pop(x) vp, var_samp(x) v FROM m GROUP BY 1),
t AS (SELECT sum(n*mu)/sum(n) grand, sum(n) n, count(*)::DOUBLE k FROM g),
ss AS (SELECT sum(g.n*(mu-grand)*(mu-grand)) b, sum(g.n*vp) w, any_value(t.n) n, any_value(k) k FROM g, t)"""


@query("anova_oneway", f"""WITH {UNIT_RISK}, {_ANOVA} SELECT {r6('(b/(k-1))/(w/(n-k))')} f_statistic, (k-1)::BIGINT df_between,
  (n-k)::BIGINT df_residual, {r6('b/(b+w)')} eta_squared FROM ss""")
def anova_query(spark, folder):
    out = hyp.anova_oneway(_unit_risk(spark, folder), "Region", "Disaster_Risk_Score")
    return out.select("df_between", "df_residual", *_r("f_statistic", "eta_squared"))


@query("levene", f"""WITH {UNIT_RISK.replace('m AS', 'm0 AS')}, md AS (SELECT Region, median(x) md FROM m0 GROUP BY 1),
  m AS (SELECT Region, abs(x-md) x FROM m0 JOIN md USING (Region)), {_ANOVA}
  SELECT {r6('(b/(k-1))/(w/(n-k))')} w_statistic, (k-1)::BIGINT df_between, (n-k)::BIGINT df_residual FROM ss""")
def levene_query(spark, folder):
    out = hyp.levene(_unit_risk(spark, folder), "Region", "Disaster_Risk_Score")
    return out.select("df_between", "df_residual", *_r("w_statistic"))


@query("anova_welch", f"""WITH {UNIT_RISK}, {_ANOVA}, wt AS (SELECT n, mu, n/v w FROM g),
  s AS (SELECT sum(w) sw, sum(w*mu)/sum(w) mw, count(*)::DOUBLE k FROM wt),
  z AS (SELECT any_value(k) k, sum(w*(mu-mw)*(mu-mw)) b, sum((1-w/sw)*(1-w/sw)/(n-1)) l FROM wt, s)
  SELECT CASE WHEN single THEN NULL ELSE {r6('(b/(k-1))/(1+2*(k-2)*l/(k*k-1))')} END f_statistic, (k-1)::BIGINT df_num,
  CASE WHEN single THEN NULL ELSE {r6('(k*k-1)/(3*l)')} END df_denom FROM z, (SELECT min(n)<2 single FROM g)""")
def welch_query(spark, folder):
    out = hyp.anova_welch(_unit_risk(spark, folder), "Region", "Disaster_Risk_Score")
    return out.select(F.col("df_num").cast("bigint").alias("df_num"), *_r("f_statistic", "df_denom"))


_CHI = """o AS (SELECT Region r, Risk_Category c, count(*)::DOUBLE o FROM modal GROUP BY 1,2),
rr AS (SELECT r, sum(o) rn FROM o GROUP BY 1), cc AS (SELECT c, sum(o) cn FROM o GROUP BY 1), nn AS (SELECT sum(o) n FROM o),
e AS (SELECT rr.r, cc.c, rn*cn/n e, coalesce(o.o,0) o FROM rr CROSS JOIN cc CROSS JOIN nn LEFT JOIN o ON o.r=rr.r AND o.c=cc.c)"""


@query("chi_square", f"""WITH {MODAL}, {_CHI}, x AS (SELECT sum((o-e)*(o-e)/e) chi2, sum(o) n, count(DISTINCT r) nr, count(DISTINCT c) nc,
  min(e) me, 100.0::DOUBLE*count(*) FILTER (e<5)/count(*) pc FROM e),
  y AS (SELECT *, CASE WHEN least(nr,nc)>1 THEN sqrt(abs(chi2)/(n*(least(nr,nc)-1))) ELSE 0 END v FROM x)
  SELECT n::BIGINT n_observations, {r6('chi2')} chi2, ((nr-1)*(nc-1))::BIGINT dof, {r6('me')} min_expected, {r6('pc')} pct_cells_below_5, {r6('v')} cramers_v,
  CASE WHEN v<0.1 THEN 'negligible' WHEN v<0.3 THEN 'small to moderate' WHEN v<0.5 THEN 'moderate to large' ELSE 'large' END effect FROM y""")
def chi_square_query(spark, folder):
    modal = agg.modal_category(v.indexed(spark, folder), ["District", "Region"], "Risk_Category")
    out = hyp.chi_square(modal, "Region", "Risk_Category")
    return out.select("n_observations", F.col("dof").cast("bigint").alias("dof"), "effect", *_r("chi2", "min_expected", "pct_cells_below_5", "cramers_v"))


def _perm_cte(source: str, unit: str, value: str, keep: str, reps: int, seed: int) -> str:
    return f"""nums AS (SELECT {value} pv, row_number() OVER (ORDER BY {unit}) pos FROM {source}),
slots AS (SELECT rep, {unit}, {keep}, row_number() OVER (PARTITION BY rep ORDER BY {o.uniform(str(seed), 'rep', unit)}, {unit}) pos
  FROM {source}, (SELECT unnest(generate_series(1,{reps})) rep)),
perm AS (SELECT rep, {unit}, {keep}, pv FROM slots JOIN nums USING (pos))"""


@query("chi_square_permutation", f"""WITH {MODAL}, {_CHI}, obs AS (SELECT round(any_value(nn.n)*(sum(o.o*o.o/(rn*cn))-1),9) chi2
  FROM o JOIN rr USING (r) JOIN cc USING (c), nn), {_perm_cte('modal', 'District', 'Risk_Category', 'Region', 9999, 42)},
  pc AS (SELECT rep, Region r, pv c, count(*)::DOUBLE o FROM perm GROUP BY 1,2,3),
  px AS (SELECT rep, round(any_value(n)*(sum(o*o/(rn*cn))-1),9) x FROM pc JOIN rr USING (r) JOIN cc USING (c), nn GROUP BY 1)
  SELECT {r6('any_value(chi2)')} chi2_observed, count(*)::BIGINT n_permutations, count(*) FILTER (x>=chi2)::BIGINT n_as_large,
  {r6('(count(*) FILTER (x>=chi2)+1)/(count(*)+1)::DOUBLE')} p_value FROM px, obs""")
def chi_square_permutation_query(spark, folder):
    modal = agg.modal_category(v.indexed(spark, folder), ["District", "Region"], "Risk_Category")
    out = hyp.chi_square_permutation(modal, "District", "Region", "Risk_Category")
    return out.select("n_permutations", "n_as_large", *_r("chi2_observed", "p_value"))


SERIES = f"""{o.PANEL}, s AS (SELECT District, "Year" t, sum(Disaster_Occurred)::DOUBLE x FROM panel GROUP BY 1,2),
pairs AS (SELECT a.District, b.t-a.t dt, b.x-a.x dx FROM s a JOIN s b ON a.District=b.District AND a.t<b.t)"""


def _annual(spark, folder):
    return agg.events_per(v.panel(spark, folder), ["District", "Year"])


@query("pairs_self_join", f"""WITH {SERIES} SELECT District, count(*) FILTER (dx>0) n_rising, count(*) FILTER (dx<0) n_falling,
  count(*) FILTER (dx=0) n_tied FROM pairs GROUP BY 1""")
def pairs_query(spark, folder):
    return hyp.pair_counts(_annual(spark, folder), ["District"], "Year", "n_events").select("District", "n_rising", "n_falling", "n_tied")


@query("mann_kendall", f"""WITH {SERIES}, sg AS (SELECT District, sum(sign(dx))::BIGINT s, median(dx/dt) slope FROM pairs GROUP BY 1),
  ties AS (SELECT District, sum(c*(c-1)*(2*c+5)) ts FROM (SELECT District, x, count(*)::DOUBLE c FROM s GROUP BY 1,2) GROUP BY 1),
  nn AS (SELECT District, count(*)::DOUBLE n FROM s GROUP BY 1),
  q AS (SELECT *, (n*(n-1)*(2*n+5)-ts)/18.0::DOUBLE vs FROM sg JOIN ties USING (District) JOIN nn USING (District))
  SELECT District, s, {r6('vs')} var_s, {r6('s/(n*(n-1)/2)')} tau, {r6('slope')} sens_slope,
  {r6('CASE WHEN s>0 THEN (s-1)/sqrt(vs) WHEN s<0 THEN (s+1)/sqrt(vs) ELSE 0 END')} z,
  CASE WHEN s>0 THEN 'increasing' WHEN s<0 THEN 'decreasing' ELSE 'no trend' END direction FROM q""")
def mann_kendall_query(spark, folder):
    out = hyp.mann_kendall(_annual(spark, folder), ["District"], "Year", "n_events")
    return out.select("District", "s", "direction", *_r("var_s", "tau", "sens_slope", "z"))


@query("sens_slope", f"WITH {SERIES} SELECT District, {r6('median(dx/dt)')} sens_slope FROM pairs GROUP BY 1")
def sens_slope_query(spark, folder):
    return hyp.sens_slope(_annual(spark, folder), ["District"], "Year", "n_events").select("District", *_r("sens_slope"))


@query("ols_cluster_robust", f"""WITH {o.PANEL}, d AS (SELECT District g, Economic_Loss_Million y, Hazard_Severity x FROM panel WHERE Disaster_Occurred=1),
  c AS (SELECT avg(x) mx, avg(y) my, regr_slope(y,x) b, regr_intercept(y,x) a, regr_r2(y,x) r2, count(*)::DOUBLE n, regr_sxx(y,x) sxx FROM d),
  u AS (SELECT g, sum(y-a-b*x) u0, sum((y-a-b*x)*(x-mx)) u1 FROM d, c GROUP BY 1),
  k AS (SELECT count(*)::DOUBLE ng, sum(u0*u0) m00, sum(u0*u1) m01, sum(u1*u1) m11 FROM u),
  f AS (SELECT *, (ng/(ng-1))*((n-1)/(n-2)) cf FROM k, c),
  r AS (SELECT *, sqrt(cf*m11/(sxx*sxx)) se1, sqrt(cf*(m00/(n*n)-2*mx*m01/(n*sxx)+mx*mx*m11/(sxx*sxx))) se0 FROM f)
  SELECT 'Intercept' term, {r6('a')} coefficient, {r6('se0')} std_error, n::BIGINT n, ng::BIGINT n_clusters, {r6('r2')} r_squared, {r6('1-(1-r2)*(n-1)/(n-2)')} adj_r_squared FROM r
  UNION ALL SELECT 'Hazard_Severity', {r6('b')}, {r6('se1')}, n::BIGINT, ng::BIGINT, {r6('r2')}, {r6('1-(1-r2)*(n-1)/(n-2)')} FROM r""")
def ols_query(spark, folder):
    events = v.panel(spark, folder).where("Disaster_Occurred = 1").select("District", "Economic_Loss_Million", "Hazard_Severity")
    out = hyp.ols_cluster_robust(durable(events), "Economic_Loss_Million", ["Hazard_Severity"], "District")
    return out.select("term", "n", "n_clusters", *_r("coefficient", "std_error", "r_squared", "adj_r_squared"))


_OLS5 = ["Hazard_Severity", "Population_Density", "Infrastructure_Density", "Poverty_Rate", "Preparedness_Score"]


@query("ols_five_predictors")
def ols5_query(spark, folder):
    events = v.indexed(spark, folder).where("Disaster_Occurred = 1").select("District", "Economic_Loss_Million", *_OLS5)
    return hyp.ols_cluster_robust(durable(events), "Economic_Loss_Million", _OLS5, "District")


@query("vif", f"""WITH {o.PANEL}, d AS (SELECT 1/(1-pow(corr(Hazard_Severity, Poverty_Rate),2)) f FROM panel WHERE Disaster_Occurred=1)
  SELECT 'Hazard_Severity' predictor, {r6('f')} vif FROM d UNION ALL SELECT 'Poverty_Rate', {r6('f')} FROM d""")
def vif_query(spark, folder):
    events = v.panel(spark, folder).where("Disaster_Occurred = 1")
    return hyp.vif(events, ["Hazard_Severity", "Poverty_Rate"]).select("predictor", *_r("vif"))


@query("spearman", f"""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity DESC)+(count(*) OVER (PARTITION BY l_quantity)-1)/2.0::DOUBLE a,
  rank() OVER (ORDER BY l_extendedprice DESC)+(count(*) OVER (PARTITION BY l_extendedprice)-1)/2.0::DOUBLE b FROM lineitem)
  SELECT count(*) n, {r6('corr(a,b)')} rho FROM r""")
def spearman_query(spark, folder):
    lines = v.read_table(spark, folder, "lineitem")
    return hyp.spearman(lines, "l_quantity", "l_extendedprice").select("n", *_r("rho"))


# --- spatial ----------------------------------------------------------------


def _knn(k: int) -> str:
    return f"""knn{k} AS (SELECT i, j, d2, rn FROM (SELECT a.District i, b.District j,
  (b.Latitude-a.Latitude)*(b.Latitude-a.Latitude)+(b.Longitude-a.Longitude)*(b.Longitude-a.Longitude) d2,
  row_number() OVER (PARTITION BY a.District ORDER BY (b.Latitude-a.Latitude)*(b.Latitude-a.Latitude)+(b.Longitude-a.Longitude)*(b.Longitude-a.Longitude), b.District) rn
  FROM units a JOIN units b ON a.District<>b.District) WHERE rn<={k})"""


@query("knn_edges", f"WITH {o.UNITS}, {_knn(5)} SELECT i District, j neighbour, {r6('d2')} d2, rn::INT \"rank\" FROM knn5")
def knn_query(spark, folder):
    return spatial.knn_edges(v.units(spark, folder), 5).select("District", "neighbour", "rank", *_r("d2"))


def _moran(source: str, k: int) -> str:
    return f"""mz AS (SELECT District, x-(SELECT avg(x) FROM {source}) z FROM {source}),
mi AS (SELECT (SELECT count(*) FROM mz)::DOUBLE n, (SELECT sum(z*z) FROM mz) ss, sum(a.z*b.z/deg) num, sum(1.0::DOUBLE/deg) s0
  FROM (SELECT *, count(*) OVER (PARTITION BY i) deg FROM knn{k}) JOIN mz a ON a.District=i JOIN mz b ON b.District=j)"""


_RATES = f"{o.PANEL}, ur AS (SELECT District, avg(Disaster_Occurred) x FROM panel GROUP BY 1)"


@query("morans_i", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_RATES}, {_knn(k)}, {_moran('ur', k)} SELECT {k} k, {r6('n/s0*num/ss')} morans_i, {r6('-1/(n-1)')} expected_i, n::BIGINT n_units FROM mi)"
    for k in (3, 4, 5, 8)))
def morans_query(spark, folder):
    rates = durable(agg.unit_means(v.panel(spark, folder), ["Disaster_Occurred"]))
    edges = durable(spatial.knn_edges(v.units(spark, folder), 8))
    out = None
    for k in (3, 4, 5, 8):
        row = spatial.morans_i(rates, edges.where(F.col("rank") <= k), "District", "Disaster_Occurred")
        row = row.select(F.lit(k).alias("k"), "n_units", *_r("morans_i", "expected_i"))
        out = row if out is None else out.unionByName(row)
    return out


def _moran_perm(source: str, k: int, reps: int, seed: int) -> str:
    return f"""{_moran(source, k)}, ob AS (SELECT round(n/s0*num/ss,9) oi FROM mi),
{_perm_cte('mz', 'District', 'z', '0 AS keep0', reps, seed).replace('0 AS keep0, pv', 'pv')},
pm AS (SELECT a.rep, round(any_value(mi.n)/any_value(mi.s0)*sum(a.pv*b.pv/deg)/any_value(mi.ss),9) i
  FROM (SELECT *, count(*) OVER (PARTITION BY i) deg FROM knn{k}) e JOIN perm a ON a.District=e.i JOIN perm b ON b.District=e.j AND b.rep=a.rep, mi GROUP BY 1)"""


_MORAN_OUT = f"""SELECT {r6('any_value(oi)')} morans_i, count(*)::BIGINT n_permutations, count(*) FILTER (abs(i)>=abs(oi))::BIGINT n_as_large,
  {r6('CASE WHEN stddev_pop(i)>0 THEN (any_value(oi)-avg(i))/stddev_pop(i) ELSE 0 END', 5)} z_score,
  {r6('(count(*) FILTER (abs(i)>=abs(oi))+1)/(count(*)+1)::DOUBLE')} p_value FROM pm, ob"""


@query("morans_permutation", f"WITH {_RATES}, {_knn(4)}, {_moran_perm('ur', 4, 999, 42)} {_MORAN_OUT}")
def morans_permutation_query(spark, folder):
    rates = durable(agg.unit_means(v.panel(spark, folder), ["Disaster_Occurred"]))
    edges = durable(spatial.knn_edges(v.units(spark, folder), 4))
    out = spatial.morans_permutation(rates, edges, "District", "Disaster_Occurred")
    return out.select("n_permutations", "n_as_large", *_r("morans_i", "p_value"), *_r("z_score", digits=5))


_RESID = f"""{o.FEATURED}, res AS (SELECT District, avg(Disaster_Occurred-0.15::DOUBLE*Previous_Month_Disaster_Occurred-Poverty_Rate/4) x FROM featured GROUP BY 1)"""


@query("residual_morans", " UNION ALL ".join(
    f"SELECT {k} k, * FROM (WITH {_RESID}, {_knn(k)}, {_moran_perm('res', k, 999, 7)} {_MORAN_OUT})" for k in (3, 5, 8)))
def residual_morans_query(spark, folder):
    featured = v.featured(spark, folder).withColumn(
        "p", F.lit(0.15) * F.col("Previous_Month_Disaster_Occurred") + F.col("Poverty_Rate") / 4
    )
    residuals = durable(
        spatial.unit_residuals(featured, "District", "Disaster_Occurred", "p", "Latitude", "Longitude", "Event_Date")
    )
    edges = durable(spatial.knn_edges(residuals, 8))
    out = None
    for k in (3, 5, 8):
        part = spatial.morans_permutation(residuals, edges.where(F.col("rank") <= k), "District", "residual", 999, 7)
        part = part.select(F.lit(k).alias("k"), "n_permutations", "n_as_large", *_r("morans_i", "p_value"), *_r("z_score", digits=5))
        out = part if out is None else out.unionByName(part)
    return out


# --- residual diagnostics ---------------------------------------------------


def _error():
    return F.col("y") - F.col("y_hat")



@query("residual_shape", f"""WITH {o.LINE_LOSSES}, e AS (SELECT y-y_hat e, avg(y-y_hat) OVER () m FROM line_losses),
  c AS (SELECT count(*) n, avg(pow(e-m,2)) m2, avg(pow(e-m,3)) m3, avg(pow(e-m,4)) m4 FROM e),
  s AS (SELECT n, m3/pow(m2,1.5) sk, m4/(m2*m2)-3 ku FROM c)
  SELECT n, {r6('sk')} skewness, {r6('ku')} kurtosis, {r6('n/6.0::DOUBLE*(sk*sk+ku*ku/4)', 4)} jarque_bera FROM s""")
def residual_shape_query(spark, folder):
    out = hyp.residual_shape(v.line_losses(spark, folder), _error())
    return out.select("n", *_r("skewness", "kurtosis"), *_r("jarque_bera", digits=4))


@query("residual_normality_ks")
def ks_query(spark, folder):
    return hyp.ks_normal(v.losses(spark, folder), _error())


@query("residual_normality_ad", f"""WITH {o.LOSSES}, e AS (SELECT y-y_hat e FROM losses), m AS (SELECT count(*) n, avg(e) mu, stddev_samp(e) sd FROM e),
  z AS (SELECT (e-mu)/sd z, n, row_number() OVER (ORDER BY e) i FROM e, m), g AS (SELECT unnest(generate_series(0,1200)) k),
  t AS (SELECT i, any_value(n) n, any_value(z) z, sum((CASE WHEN k IN (0,1200) THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)*exp(-pow(abs(z)/sqrt(2)+k*0.005::DOUBLE,2)))*0.005::DOUBLE/3/sqrt(pi()) q FROM z, g GROUP BY i),
  l AS (SELECT i, n, CASE WHEN z<0 THEN ln(q) ELSE ln(1-q) END lo, CASE WHEN z<0 THEN ln(1-q) ELSE ln(q) END hi FROM t)
  SELECT n, {r6('-n-s/n', 4)} a_squared FROM (SELECT any_value(n)::BIGINT n, sum((2*i-1)*lo+(2*(n-i)+1)*hi) s FROM l)""")
def anderson_query(spark, folder):
    return hyp.anderson_darling(v.losses(spark, folder), _error()).select("n", *_r("a_squared", digits=4))


@query("heteroscedasticity", f"""WITH {o.LINE_LOSSES}, p AS (SELECT y_hat a, abs(y-y_hat) b FROM line_losses),
  r AS (SELECT rank() OVER (ORDER BY a DESC)+(count(*) OVER (PARTITION BY a)-1)/2.0::DOUBLE ra,
  rank() OVER (ORDER BY b DESC)+(count(*) OVER (PARTITION BY b)-1)/2.0::DOUBLE rb FROM p)
  SELECT count(*) n, {r6('corr(ra,rb)')} rho FROM r""")
def heteroscedasticity_query(spark, folder):
    return hyp.heteroscedasticity(v.line_losses(spark, folder), "y", "y_hat").select("n", *_r("rho"))


@query("influence_count", f"""WITH {o.LINE_LOSSES}, e AS (SELECT y-y_hat e FROM line_losses), s AS (SELECT count(*) n, sqrt(avg(e*e))+1e-10 r FROM e)
  SELECT any_value(n) n_observations, count(*) FILTER (pow(e/r,2)/30.0>4.0/n) n_influential,
  {r6('100.0*count(*) FILTER (pow(e/r,2)/30.0>4.0/n)/any_value(n)')} pct_influential FROM e, s""")
def influence_query(spark, folder):
    return hyp.influence_count(v.line_losses(spark, folder), "y", "y_hat").select("n_observations", "n_influential", *_r("pct_influential"))


@query("qq_points", f"""WITH {o.LINE_LOSSES} SELECT {r6('pr')} prob, {r6('q', 4)} sample FROM (SELECT
  unnest([{','.join(f'{(i + 1) / 100!r}::DOUBLE' for i in range(99))}]) pr,
  unnest(quantile_cont(y-y_hat, [{','.join(f'{(i + 1) / 100!r}' for i in range(99))}])) q FROM line_losses)""")
def qq_query(spark, folder):
    return hyp.qq_points(v.line_losses(spark, folder), _error()).select(*_r("prob"), *_r("sample", digits=4))


_PCT = [1, 5, 25, 50, 75, 95, 99]


@query("residual_percentiles", f"WITH {o.LINE_LOSSES} SELECT " + ", ".join(
    f"{r6(f'quantile_cont(y-y_hat,{p / 100})', 4)} p{p}" for p in _PCT) + " FROM line_losses")
def residual_percentiles_query(spark, folder):
    return hyp.residual_percentiles(v.line_losses(spark, folder), _error()).select(*_r(*[f"p{p}" for p in _PCT], digits=4))


# --- index sensitivity ------------------------------------------------------

MEANS = f"""{o.INDEXED}, um AS (SELECT District, avg(Hazard_Score) c0, avg(Exposure_Score) c1, avg(Vulnerability_Score) c2,
  avg(Preparedness_Deficit_Score) c3, avg(Disaster_Risk_Score) risk, count(*) n_rows FROM indexed GROUP BY 1)"""
_WEIGHTS = [0.30, 0.25, 0.25, 0.20]


def _unit_components(spark, folder):
    means = agg.unit_means(v.indexed(spark, folder), [*COMPONENTS, "Disaster_Risk_Score"])
    return durable(means)


def _ranks(weights_cte: str, ids: str) -> str:
    """sim ranks per weight row, baseline ranks; both average ties."""
    return f"""{MEANS}, {weights_cte},
sc AS (SELECT {ids}, District, round(w0*c0+w1*c1+w2*c2+w3*c3,9) s, round(risk,9) b FROM um, wt),
rk AS (SELECT {ids}, District, rank() OVER (PARTITION BY {ids} ORDER BY s DESC)+(count(*) OVER (PARTITION BY {ids}, s)-1)/2.0::DOUBLE sr,
  rank() OVER (PARTITION BY {ids} ORDER BY b DESC)+(count(*) OVER (PARTITION BY {ids}, b)-1)/2.0::DOUBLE br FROM sc)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _knockout_rows():
    rows = []
    for i, name in enumerate(COMPONENTS):
        left = sum(w for j, w in enumerate(_WEIGHTS) if j != i)
        rows.append((name, *[0.0 if j == i else w / left for j, w in enumerate(_WEIGHTS)]))
    return rows


@query("knockout", f"""WITH {_ranks(f'wt AS (SELECT * FROM (VALUES {_values(_knockout_rows())}) t(component,w0,w1,w2,w3))', 'component')}
  SELECT component, {r6('corr(br,sr)')} rho, CASE WHEN corr(br,sr)>0.95 THEN 'minimally' WHEN corr(br,sr)>0.85 THEN 'moderately' ELSE 'substantially' END effect
  FROM rk GROUP BY 1""")
def knockout_query(spark, folder):
    return unc.knockout(_unit_components(spark, folder)).select("component", "effect", *_r("rho"))


_SWEEP = """mult AS (SELECT unnest(generate_series(0,20)) step), comps AS (SELECT unnest([0,1,2,3]) ci, unnest(['Hazard_Score','Exposure_Score','Vulnerability_Score','Preparedness_Deficit_Score']) component),
raw AS (SELECT component, step, round(step*0.1::DOUBLE,10) multiplier, 0.3::DOUBLE*(CASE WHEN ci=0 THEN step*0.1::DOUBLE ELSE 1 END) r0, 0.25::DOUBLE*(CASE WHEN ci=1 THEN step*0.1::DOUBLE ELSE 1 END) r1,
  0.25::DOUBLE*(CASE WHEN ci=2 THEN step*0.1::DOUBLE ELSE 1 END) r2, 0.2::DOUBLE*(CASE WHEN ci=3 THEN step*0.1::DOUBLE ELSE 1 END) r3 FROM comps, mult),
wt AS (SELECT component, step, multiplier, r0/(r0+r1+r2+r3) w0, r1/(r0+r1+r2+r3) w1, r2/(r0+r1+r2+r3) w2, r3/(r0+r1+r2+r3) w3 FROM raw)"""


@query("weight_sweep", f"""WITH {_ranks(_SWEEP, 'component, step, multiplier')}, rh AS (SELECT component, step, multiplier, round(corr(br,sr),4) rho FROM rk GROUP BY 1,2,3)
  SELECT component, {r6('multiplier')} multiplier, rho, min(rho) OVER (PARTITION BY component) min_rho,
  {r6('first_value(multiplier) OVER (PARTITION BY component ORDER BY rho, step)')} most_sensitive_multiplier FROM rh""")
def weight_sweep_query(spark, folder):
    out = unc.weight_sweep(_unit_components(spark, folder))
    return out.select("component", "rho", "min_rho", *_r("multiplier", "most_sensitive_multiplier"))


@query("equal_weight_rho", f"""WITH {_ranks("wt AS (SELECT 1 sim, 0.25::DOUBLE w0, 0.25::DOUBLE w1, 0.25::DOUBLE w2, 0.25::DOUBLE w3)", 'sim')}
  SELECT count(*) n_units, {r6('corr(br,sr)')} rho FROM rk""")
def equal_weight_query(spark, folder):
    weights = spark.createDataFrame([(1, 0.25, 0.25, 0.25, 0.25)], "sim int, w0 double, w1 double, w2 double, w3 double")
    return unc.rank_correlations(_unit_components(spark, folder), weights, ["sim"]).select("n_units", *_r("rho"))


def _sim_weights(n: int, seed: int = 42) -> str:
    raws = ", ".join(f"0.1::DOUBLE+{0.9 - 0.1!r}::DOUBLE*{o.uniform(str(seed), 'sim', str(i))} r{i}" for i in range(4))
    return f"""wr AS (SELECT sim, {raws} FROM (SELECT unnest(generate_series(1,{n})) sim)),
wt AS (SELECT sim, r0/(r0+r1+r2+r3) w0, r1/(r0+r1+r2+r3) w1, r2/(r0+r1+r2+r3) w2, r3/(r0+r1+r2+r3) w3 FROM wr)"""


_RWS = _ranks(_sim_weights(200), "sim") + """,
tk AS (SELECT sim, District, row_number() OVER (PARTITION BY sim ORDER BY sr, District) a, row_number() OVER (PARTITION BY sim ORDER BY br, District) b FROM rk),
ov AS (SELECT sim, count(*) FILTER (a<=10 AND b<=10)/10.0::DOUBLE ov FROM tk GROUP BY 1),
rh AS (SELECT sim, corr(br,sr) rho FROM rk GROUP BY 1)"""


@query("random_weight_sensitivity", f"""WITH {_RWS} SELECT {r6('avg(rho)')} mean_rho, {r6('stddev_pop(rho)')} std_rho, {r6('avg(ov)')} top_k_stability,
  count(*)::BIGINT n_sims FROM rh JOIN ov USING (sim)""")
def random_weight_query(spark, folder):
    _, _, overall = unc.random_weight_sensitivity(_unit_components(spark, folder), unc.uniform_weights(spark, 200))
    return overall.select("n_sims", *_r("mean_rho", "std_rho", "top_k_stability"))


@query("random_weight_ranks", f"""WITH {_RWS} SELECT District, {r6('max(br)')} expert_rank, {r6('quantile_cont(sr,0.5)')} median_rank,
  {r6('quantile_cont(sr,0.05)')} rank_p5, {r6('quantile_cont(sr,0.95)')} rank_p95 FROM rk GROUP BY 1""")
def random_weight_ranks_query(spark, folder):
    _, per_unit, _ = unc.random_weight_sensitivity(_unit_components(spark, folder), unc.uniform_weights(spark, 200))
    return per_unit.select("District", *_r("expert_rank", "median_rank", "rank_p5", "rank_p95"))


@query("top_k_overlap", f"WITH {_RWS} SELECT sim, {r6('ov')} top_k_overlap FROM ov")
def top_k_overlap_query(spark, folder):
    per_sim, _, _ = unc.random_weight_sensitivity(_unit_components(spark, folder), unc.uniform_weights(spark, 200))
    return per_sim.select("sim", *_r("top_k_overlap"))


# --- Monte Carlo ------------------------------------------------------------

_MC = f"""{MEANS}, {_sim_weights(1000)}, sc AS (SELECT sim, District, n_rows, w0*c0+w1*c1+w2*c2+w3*c3 s FROM um, wt)"""


@query("weights_cross_join", f"WITH {_MC} SELECT sim, District, {r6('s')} score FROM sc")
def weights_cross_query(spark, folder):
    sims = unc.simulated_scores(_unit_components(spark, folder), unc.uniform_weights(spark, 1000), ["sim"])
    return sims.select("sim", "District", *_r("score"))


@query("dirichlet_weights")
def dirichlet_query(spark, folder):
    sims = unc.simulated_scores(_unit_components(spark, folder), unc.dirichlet_weights(spark, 1000), ["sim"])
    return sims.groupBy("District").agg(F.avg("score").alias("mean_risk"), F.stddev_pop("score").alias("std_risk"))


@query("mc_risk_index", f"""WITH {_MC} SELECT District, {r6('avg(s)')} mean_risk, {r6('quantile_cont(s,0.5)')} median_risk, {r6('stddev_pop(s)')} std_risk,
  {r6('quantile_cont(s,0.025)')} ci_lower_2_5, {r6('quantile_cont(s,0.975)')} ci_upper_97_5, {r6('quantile_cont(s,0.05)')} ci_lower_5,
  {r6('quantile_cont(s,0.95)')} ci_upper_95 FROM sc GROUP BY 1""")
def mc_risk_query(spark, folder):
    out = unc.mc_risk_index(_unit_components(spark, folder), unc.uniform_weights(spark, 1000))
    return out.select("District", *_r(*[c for c in out.columns if c != "District"]))


_ORDER_WEIGHTS = _sim_weights(1000).replace("(SELECT unnest(generate_series(1,1000)) sim)", "(SELECT o_orderkey sim FROM orders)")


@query("mc_weight_stats", f"WITH {_ORDER_WEIGHTS} " + " UNION ALL ".join(
    f"SELECT 'w{i}' weight, {r6(f'avg(w{i})')} \"mean\", {r6(f'stddev_pop(w{i})')} \"std\", {r6(f'min(w{i})')} \"min\", {r6(f'max(w{i})')} \"max\" FROM wt"
    for i in range(4)))
def mc_weight_query(spark, folder):
    sims = v.read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("sim"))
    return unc.mc_weight_stats(unc.weights_for(sims)).select("weight", *_r("mean", "std", "min", "max"))


@query("mc_convergence", f"""WITH {_MC}, cp AS (SELECT unnest([100,200,500,1000]) n),
  a AS (SELECT n, avg(m) gm, stddev_pop(m) sm FROM cp JOIN (SELECT sim, sum(s*n_rows)/sum(n_rows) m FROM sc GROUP BY 1) q ON sim<=n GROUP BY 1),
  b AS (SELECT n, stddev_pop(m) um FROM (SELECT n, District, avg(s) m FROM cp JOIN sc ON sim<=n GROUP BY 1,2) GROUP BY 1)
  SELECT n::INT n_iterations, {r6('gm')} grand_mean, {r6('sm')} std_across_sims, {r6('um')} std_of_unit_means FROM a JOIN b USING (n)""")
def mc_convergence_query(spark, folder):
    indexed = v.indexed(spark, folder)
    means = durable(
        indexed.groupBy("District").agg(*[F.avg(c).alias(c) for c in COMPONENTS], F.count(F.lit(1)).alias("n_rows"))
    )
    out = unc.mc_convergence(means.drop("n_rows"), means, unc.uniform_weights(spark, 1000))
    return out.select("n_iterations", *_r("grand_mean", "std_across_sims", "std_of_unit_means"))


_ORD = f"""{_MC}, orr AS (SELECT sim, District, row_number() OVER (PARTITION BY sim ORDER BY round(s,9) DESC, District) rk FROM sc)"""


@query("rank_ordinal", f"WITH {_ORD} SELECT sim, District, rk::INT \"rank\" FROM orr")
def rank_ordinal_query(spark, folder):
    means = _unit_components(spark, folder)
    sims = unc.simulated_scores(means, unc.uniform_weights(spark, 1000), ["sim"]).withColumn("score", F.round("score", 9))
    return unc.ordinal_rank(sims, ["sim"], "score", "District").select("sim", "District", "rank")


@query("mc_rank_stability", f"""WITH {_ORD}, md AS (SELECT District, median(rk) md FROM orr GROUP BY 1),
  st AS (SELECT District, avg((abs(rk-md)<=5)::INT) s FROM orr JOIN md USING (District) GROUP BY 1)
  SELECT {r6('avg(s)')} overall_stability, {r6('min(s)')} min_stability, {r6('max(s)')} max_stability FROM st""")
def mc_stability_query(spark, folder):
    out = unc.mc_rank_stability(_unit_components(spark, folder), unc.uniform_weights(spark, 1000))
    return out.select(*_r("overall_stability", "min_stability", "max_stability"))


# --- bootstrap --------------------------------------------------------------


def _draws(source: str, reps: int, seed: int) -> str:
    return f"""bu AS (SELECT unit, row_number() OVER (ORDER BY unit)-1 bi FROM (SELECT DISTINCT unit FROM {source})),
bn AS (SELECT count(*)::DOUBLE n FROM bu),
dr AS (SELECT rep, floor({o.uniform(str(seed), 'rep', 'bi')}*n)::BIGINT bi FROM bu, bn, (SELECT unnest(generate_series(1,{reps})) rep)),
draws AS (SELECT rep, unit, count(*)::BIGINT mult FROM dr JOIN bu USING (bi) GROUP BY 1,2)"""


@query("replicate_join", f"""WITH {o.SCORED}, {_draws('scored', 500, 42)}, uc AS (SELECT unit, count(*) c, sum(y) s FROM scored GROUP BY 1)
  SELECT rep, sum(c*mult)::BIGINT n, sum(s*mult)::BIGINT pos FROM draws JOIN uc USING (unit) GROUP BY 1""")
def replicate_join_query(spark, folder):
    sums = durable(v.scored(spark, folder).groupBy("unit").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("s")))
    draws = permute.cluster_draws(sums, "unit", 500)
    return permute.weighted_replicates(sums, draws, "unit").groupBy("rep").agg(
        F.sum(F.col("c") * F.col("mult")).alias("n"), F.sum(F.col("s") * F.col("mult")).alias("pos")
    )


@query("union_replicates", f"WITH {o.SCORED}, {_draws('scored', 500, 5)} SELECT rep, unit, mult FROM draws")
def union_replicates_query(spark, folder):
    return permute.cluster_draws(v.scored(spark, folder), "unit", 500, 5)


def _interval(column: str, source: str) -> str:
    return f"SELECT '{column}' metric, {r6(f'quantile_cont({column},0.025)')} \"lower\", {r6(f'quantile_cont({column},0.975)')} \"upper\", count(*)::BIGINT n_replicates FROM {source}"


@query("cluster_bootstrap_ci", f"""WITH {o.SCORED}, {_draws('scored', 500, 42)},
  bh AS (SELECT rep, p, sum(mult)::DOUBLE n, sum(mult*y)::DOUBLE pos FROM scored JOIN draws USING (unit) GROUP BY 1,2),
  bt AS (SELECT rep, sum(n) n, sum(pos) a, sum(n-pos) b FROM bh GROUP BY 1),
  bc AS (SELECT rep, p, n, pos, sum(pos) OVER w tp, sum(n-pos) OVER w fp FROM bh WINDOW w AS (PARTITION BY rep ORDER BY p DESC)),
  bp AS (SELECT rep, p, tp/(tp+fp) pre, tp/a rec, fp/b fpr FROM bc JOIN bt USING (rep)),
  bs AS (SELECT *, lag(pre,1,1.0::DOUBLE) OVER w pre0, lag(rec,1,0.0::DOUBLE) OVER w rec0, lag(fpr,1,0.0::DOUBLE) OVER w fpr0 FROM bp WINDOW w AS (PARTITION BY rep ORDER BY p DESC)),
  ba AS (SELECT rep, sum((fpr-fpr0)*(rec+rec0)/2) roc_auc, sum((rec-rec0)*(pre+pre0)/2) pr_auc FROM bs GROUP BY 1),
  bk AS (SELECT rep, sum(pos) FILTER (p>=0.3::DOUBLE) tp, sum(n-pos) FILTER (p>=0.3::DOUBLE) fp, sum(pos) FILTER (p<0.3::DOUBLE) fn FROM bh GROUP BY 1),
  br AS (SELECT roc_auc, pr_auc, tp/(tp+fn) recall, tp/(tp+fp) "precision", 2*tp/(2*tp+fp+fn) f1_score FROM ba JOIN bk USING (rep) JOIN bt USING (rep) WHERE n>=10 AND a>=2)
  """ + " UNION ALL ".join(_interval(c, "br") for c in ("roc_auc", "pr_auc", "recall", "precision", "f1_score")))
def cluster_bootstrap_query(spark, folder):
    out = unc.cluster_bootstrap_ci(v.scored(spark, folder), threshold=0.3)
    return out.select("metric", "n_replicates", *_r("lower", "upper"))


@query("bootstrap_r2_ci", f"""WITH {o.LINE_LOSSES}, {_draws('line_losses', 500, 42)},
  s AS (SELECT unit, count(*)::DOUBLE n, sum(pow(y-y_hat,2)) sse, sum(y) sy, sum(y*y) syy FROM line_losses GROUP BY 1),
  r AS (SELECT rep, sum(n*mult) n, sum(sse*mult) sse, sum(sy*mult) sy, sum(syy*mult) syy FROM s JOIN draws USING (unit) GROUP BY 1),
  q AS (SELECT 1-sse/(syy-sy*sy/n) r_squared FROM r WHERE n>=10) {_interval('r_squared', 'q')}""")
def bootstrap_r2_query(spark, folder):
    return unc.bootstrap_r2_ci(v.line_losses(spark, folder)).select("metric", "n_replicates", *_r("lower", "upper"))


@query("prediction_distribution", f"""WITH {o.SCORED} SELECT {r6('avg(p)')} "mean", {r6('stddev_pop(p)')} "std", {r6('median(p)', 8)} median,
  {r6('quantile_cont(p,0.025)', 8)} ci_2_5, {r6('quantile_cont(p,0.975)', 8)} ci_97_5 FROM scored""")
def prediction_distribution_query(spark, folder):
    out = unc.prediction_distribution(v.scored(spark, folder), "p")
    return out.select(*_r("mean", "std"), *_r("median", "ci_2_5", "ci_97_5", digits=8))


@query("residual_bootstrap_intervals", f"""WITH {o.LOSSES}, {_draws('losses', 500, 42)},
  e AS (SELECT Record_ID, unit, y, y_hat, y-y_hat e, row_number() OVER (PARTITION BY unit ORDER BY Record_ID) rn, count(*) OVER (PARTITION BY unit) n FROM losses),
  pk AS (SELECT a.Record_ID, a.y, a.y_hat, r.rep, CASE WHEN d.rep IS NULL THEN 0.0::DOUBLE ELSE b.e END e
    FROM e a CROSS JOIN (SELECT unnest(generate_series(1,500)) rep) r LEFT JOIN draws d ON d.rep=r.rep AND d.unit=a.unit
    JOIN e b ON b.unit=a.unit AND b.rn=floor({o.uniform("42", "'residual'", 'r.rep', 'a.Record_ID')}*a.n)::BIGINT+1),
  iv AS (SELECT Record_ID, any_value(y) y, any_value(y_hat) y_hat, any_value(y_hat)+quantile_cont(e,0.025) lo, any_value(y_hat)+quantile_cont(e,0.975) hi FROM pk GROUP BY 1)
  SELECT Record_ID, {r6('lo')} "lower", {r6('hi')} "upper", {r6('y')} y, {r6('y_hat')} y_hat FROM iv""")
def residual_bootstrap_query(spark, folder):
    out = unc.residual_bootstrap_intervals(v.losses(spark, folder), "Record_ID")
    return out.select("Record_ID", *_r("lower", "upper", "y", "y_hat"))


@query("residual_rank_intervals", f"""WITH {o.LOSSES}, {_draws('losses', 500, 42)},
  e AS (SELECT Record_ID, unit, y, y_hat, y-y_hat e, row_number() OVER (PARTITION BY unit ORDER BY y-y_hat, Record_ID) rn, count(*) OVER (PARTITION BY unit) n FROM losses),
  pk AS (SELECT a.Record_ID, a.y, a.y_hat, r.rep, CASE WHEN d.rep IS NULL THEN 0.0::DOUBLE ELSE b.e END e
    FROM e a CROSS JOIN (SELECT unnest(generate_series(1,500)) rep) r LEFT JOIN draws d ON d.rep=r.rep AND d.unit=a.unit
    JOIN e b ON b.unit=a.unit AND b.rn=floor({o.uniform("42", "'residual'", 'r.rep', 'a.Record_ID')}*a.n)::BIGINT+1),
  iv AS (SELECT Record_ID, any_value(y) y, any_value(y_hat) y_hat, any_value(y_hat)+quantile_cont(e,0.025) lo, any_value(y_hat)+quantile_cont(e,0.975) hi FROM pk GROUP BY 1)
  SELECT Record_ID, {r6('lo')} "lower", {r6('hi')} "upper", {r6('y')} y, {r6('y_hat')} y_hat FROM iv""")
def residual_rank_query(spark, folder):
    out = unc.residual_rank_intervals(v.losses(spark, folder), "Record_ID")
    return out.select("Record_ID", *_r("lower", "upper", "y", "y_hat"))


@query("interval_summary", f"""WITH {o.LOSSES}, iv AS (SELECT y, y_hat, y_hat-5 lo, y_hat+5 hi FROM losses)
  SELECT {r6('avg((y BETWEEN lo AND hi)::INT)')} coverage, {r6('avg(hi-lo)')} mean_width, {r6('median(hi-lo)')} median_width,
  {r6('avg(y_hat)')} mean_prediction, {r6('avg(y)')} mean_true FROM iv""")
def interval_summary_query(spark, folder):
    rows = v.losses(spark, folder).selectExpr("y", "y_hat", "y_hat - 5 AS lower", "y_hat + 5 AS upper")
    out = unc.interval_summary(rows)
    return out.select(*_r(*out.columns))
