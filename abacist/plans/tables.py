"""Queries of descriptive tables, survival, epidemiology, surveys, inequality, causal estimates and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions import columns as C
from abacist.operators import causal, describe, epi, inequality, rd, resample, series, survey, survival
from abacist.plans.registry import Tables, one, query

# ---------------------------------------------------------------- description
_STATS = "count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max"


@query("sumstats", " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, {_STATS.format(c=c)} FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_extendedprice")), 4)
def _(t):
    return describe.sumstats(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query("tab", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (1, 2)")
def _(t):
    return describe.tab(t.lineitem, "l_returnflag", "l_linestatus")


@query("chi2_independence", """WITH c AS (SELECT l_returnflag a, l_linenumber b, count(*) n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) r FROM c GROUP BY 1), k AS (SELECT b, sum(n) k FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c)
SELECT round(sum(power(coalesce(n, 0) - r*k/t, 2) / (r*k/t)), 6) AS chi2 FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)""")
def _(t):
    return one(t.spark, {"chi2": describe.chi2_independence(t.lineitem, "l_returnflag", "l_linenumber")[0]})


@query("winsor", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) lo, quantile_cont(l_extendedprice, 0.95) hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice_w FROM lineitem JOIN q USING (l_returnflag)""", 4)
def _(t):
    return describe.winsor(t.lineitem, ["l_extendedprice"], 0.05, 0.95, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_extendedprice_w")


@query("pwcorr", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8), count(*) FROM lineitem", 8)
def _(t):
    return describe.pwcorr(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "r", "n")


@query("rank", "SELECT o_orderkey, rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0::DOUBLE AS average, dense_rank() OVER w::DOUBLE AS dense FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)")
def _(t):
    return describe.ranked(t.orders, "o_totalprice", {"average": "average", "dense": "dense"}, ["o_orderstatus"]).select("o_orderkey", "average", "dense")


@query("row_statistics", "SELECT l_orderkey, l_linenumber, round(list_sum(v), 6) AS total, round(list_avg(v), 6) AS mean, round(list_max(v), 6) AS most, round(list_min(v), 6) AS least, round(list_stddev_samp(v), 6) AS sd, len(v)::INT AS n FROM (SELECT l_orderkey, l_linenumber, list_filter([l_quantity, nullif(l_discount, 0), l_tax], lambda x: x IS NOT NULL) AS v FROM lineitem)")
def _(t):
    v = ["l_quantity", F.expr("nullif(l_discount, 0)"), "l_tax"]
    return t.lineitem.select("l_orderkey", "l_linenumber", C.row_total(*v).alias("total"), C.row_mean(*v).alias("mean"), C.row_max(*v).alias("most"), C.row_min(*v).alias("least"), C.row_sd(*v).alias("sd"), C.row_count(*v).alias("n"))


@query("balance_table", """WITH d AS (SELECT o_orderstatus = 'F' t, o_totalprice x FROM orders), k AS (SELECT avg(x) FILTER (t) a, avg(x) FILTER (NOT t) b, var_samp(x) FILTER (t) v, var_samp(x) FILTER (NOT t) w, count(*) FILTER (t) n, count(*) FILTER (NOT t) m FROM d)
SELECT 'o_totalprice' AS variable, round(a, 5) AS mean_treated, round(b, 5) AS mean_control, round((a-b)/sqrt((v+w)/2), 5) AS smd, round(v/w, 5) AS variance_ratio, round((a-b)/sqrt(v/n+w/m), 5) AS t FROM k""", 5)
def _(t):
    return describe.balance_table(t.orders.withColumn("f", (F.col("o_orderstatus") == "F").cast("int")), "f", ["o_totalprice"]).drop("p_value")


@query("binscatter", """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q FROM lineitem), b AS (SELECT l_extendedprice x, l_quantity y, (1 + len(list_filter(q, lambda c: l_extendedprice > c)))::INT AS bin FROM lineitem, q)
SELECT bin, count(*) AS n, round(avg(x), 5) AS mean_x, round(avg(y), 5) AS mean_y, round(stddev_samp(y), 5) AS sd_y FROM b GROUP BY bin""", 5)
def _(t):
    return describe.binscatter(t.lineitem, "l_quantity", "l_extendedprice", 10)


@query("kdensity")
def _(t):
    return describe.kdensity(t.orders, "o_totalprice", 64)


@query("fingerprint")
def _(t):
    return t.spark.createDataFrame([(describe.fingerprint(t.nation),)], "digest string")


# ---------------------------------------------------------------- survival: time to the first purchase of a user, by parity of the id
SURV = "SELECT user_id, user_id % 2 AS g, ceil(coalesce(min(epoch(ts)) FILTER (event_type = 'purchase'), max(epoch(ts))) / 7200 - 236592) AS time, (count(*) FILTER (event_type = 'purchase') > 0)::INT AS event FROM events GROUP BY user_id"


def _surv(t: Tables):
    e = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    buy = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id", (F.col("user_id") % 2).alias("g")).agg(F.ceil(F.coalesce(F.min(F.when(buy, e)), F.max(e)) / 7200 - 236592).cast("double").alias("time"), (F.count(F.when(buy, 1)) > 0).cast("int").alias("event"))


RISK = f"d AS ({SURV}), e AS (SELECT g, time::DOUBLE AS time, sum(event)::DOUBLE AS deaths, count(*)::DOUBLE AS leave FROM d GROUP BY 1, 2), r AS (SELECT *, sum(leave) OVER (PARTITION BY g ORDER BY time DESC) AS at_risk FROM e)"


CURVE = f"""{RISK}, s AS (SELECT *, exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths/at_risk) ELSE 0 END) OVER w) * (1 - max((deaths >= at_risk)::INT) OVER w) AS survival, sum(CASE WHEN at_risk > deaths THEN deaths/(at_risk*(at_risk-deaths)) ELSE 0 END) OVER w AS v FROM r WINDOW w AS (PARTITION BY g ORDER BY time))"""


@query("kaplan_meier", f"""WITH {CURVE}
SELECT g, time, at_risk, deaths, round(survival, 6) AS survival, round(survival*sqrt(v), 6) AS std_error, round(greatest(survival - 1.959963984540054*survival*sqrt(v), 0), 6) AS ci_low, round(least(survival + 1.959963984540054*survival*sqrt(v), 1), 6) AS ci_high FROM s WHERE deaths > 0""")
def _(t):
    return survival.kaplan_meier(_surv(t), "time", "event", ["g"])


@query("nelson_aalen", f"WITH {RISK}, s AS (SELECT g, time, at_risk, deaths, round(sum(deaths/at_risk) OVER (PARTITION BY g ORDER BY time), 6) AS hazard FROM r) SELECT * FROM s WHERE deaths > 0")
def _(t):
    return survival.nelson_aalen(_surv(t), "time", "event", ["g"])


@query("logrank", f"""WITH {RISK}, t AS (SELECT DISTINCT time FROM e), g AS (SELECT t.time, sum(leave) FILTER (e.time >= t.time) n, sum(leave) FILTER (e.time >= t.time AND g = 0) n0, coalesce(sum(deaths) FILTER (e.time = t.time), 0) d, coalesce(sum(deaths) FILTER (e.time = t.time AND g = 0), 0) d0 FROM t, e GROUP BY 1),
u AS (SELECT sum(d0 - d*coalesce(n0, 0)/n) u, sum(CASE WHEN n > 1 THEN d*(n-d)/(n-1)*coalesce(n0, 0)/n*(1-coalesce(n0, 0)/n) ELSE 0 END) v FROM g WHERE d > 0) SELECT round(u*u/v, 6) AS chi2 FROM u""")
def _(t):
    return one(t.spark, {"chi2": survival.logrank(_surv(t), "time", "event", "g")[0]})


@query("median_survival", f"WITH {CURVE} SELECT g, min(time) AS median FROM s WHERE survival <= 0.5 AND deaths > 0 GROUP BY g")
def _(t):
    return survival.median_survival(_surv(t), "time", "event", ["g"])


@query("rmst", f"WITH {CURVE}, b AS (SELECT *, coalesce(lag(survival) OVER (PARTITION BY g ORDER BY time), 1) AS before FROM s) SELECT g, round(100 - coalesce(sum(CASE WHEN time < 100 THEN (100 - time)*before*deaths/at_risk END), 0), 6) AS rmst FROM b GROUP BY g")
def _(t):
    return survival.rmst(_surv(t), "time", "event", 100.0, ["g"])


@query("cox")
def _(t):
    return survival.cox(_surv(t), "time", "event", ["g"]).frame(t.spark).select("term", "estimate", "std_error")


@query("cox_breslow_robust")
def _(t):
    return survival.cox(_surv(t), "time", "event", ["g"], ties="breslow", robust=True).frame(t.spark).select("term", "estimate", "std_error")


# ---------------------------------------------------------------- epidemiology: toxic by quality, in strata of language
EPI = "SELECT lang, (quality = 0)::INT AS e, toxic AS o, n_chars FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL"


def _epi(t: Tables):
    return t.labels.join(t.documents, "doc_id").where("lang is not null").select("lang", (F.col("quality") == 0).cast("int").alias("e"), F.col("toxic").alias("o"), "n_chars")


@query("epi_2x2", f"""WITH c AS (SELECT sum(e*o)::DOUBLE a, sum(e*(1-o))::DOUBLE b, sum((1-e)*o)::DOUBLE c, sum((1-e)*(1-o))::DOUBLE d FROM ({EPI})), k AS (SELECT *, (a/(a+b))/(c/(c+d)) rr, a*d/(b*c) o, sqrt(1/a-1/(a+b)+1/c-1/(c+d)) sr, sqrt(1/a+1/b+1/c+1/d) so, a/(a+b) p, c/(c+d) q FROM c), z AS (SELECT *, 1.959963984540054 z, sqrt(p*(1-p)/(a+b)+q*(1-q)/(c+d)) sd FROM k)
SELECT a, b, c, d, round(rr, 6) AS risk_ratio, round(exp(ln(rr)-z*sr), 6) AS rr_low, round(exp(ln(rr)+z*sr), 6) AS rr_high, round(o, 6) AS odds_ratio, round(exp(ln(o)-z*so), 6) AS or_low, round(exp(ln(o)+z*so), 6) AS or_high, round(p-q, 6) AS risk_difference, round(p-q-z*sd, 6) AS rd_low, round(p-q+z*sd, 6) AS rd_high, round((rr-1)/rr, 6) AS attributable_fraction, round(1/abs(p-q), 6) AS number_needed FROM z""")
def _(t):
    return epi.measures(epi.cells(_epi(t), "e", "o"))


@query("mantel_haenszel", f"""WITH c AS (SELECT lang, sum(e*o)::DOUBLE a, sum(e*(1-o))::DOUBLE b, sum((1-e)*o)::DOUBLE c, sum((1-e)*(1-o))::DOUBLE d, count(*)::DOUBLE n FROM ({EPI}) GROUP BY 1)
SELECT round(sum(a*d/n)/sum(b*c/n), 6) AS odds_ratio, round(sum(a*(c+d)/n)/sum(c*(a+b)/n), 6) AS risk_ratio, round(power(greatest(abs(sum(a)-sum((a+b)*(a+c)/n))-0.5, 0), 2)/sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))), 6) AS chi2 FROM c""")
def _(t):
    m = epi.mantel_haenszel(_epi(t), "e", "o", ["lang"])
    return one(t.spark, {k: m[k] for k in ("odds_ratio", "risk_ratio", "chi2")})


@query("direct_standardise", f"WITH s AS (SELECT lang, sum(o)::DOUBLE e, count(*)::DOUBLE p FROM ({EPI}) WHERE e = 1 GROUP BY 1), r AS (SELECT lang, count(*)::DOUBLE s FROM documents GROUP BY 1), j AS (SELECT *, s/sum(s) OVER () w FROM s JOIN r USING (lang)) SELECT round(sum(e)/sum(p), 8) AS crude, round(sum(w*e/p), 8) AS rate, round(sum(w*w*e/(p*p)), 8) AS variance FROM j", 8)
def _(t):
    d = _epi(t).where("e = 1").groupBy("lang").agg(F.sum("o").alias("events"), F.count("*").alias("pop"))
    return epi.direct_standardise(d.join(t.documents.groupBy("lang").agg(F.count("*").alias("std")), "lang"), "events", "pop", "lang", "std")


@query("indirect_standardise", f"WITH s AS (SELECT lang, sum(o)::DOUBLE e, count(*)::DOUBLE p FROM ({EPI}) WHERE e = 1 GROUP BY 1), r AS (SELECT lang, avg(o) r FROM ({EPI}) GROUP BY 1) SELECT sum(e) AS observed, round(sum(p*r), 6) AS expected, round(sum(e)/sum(p*r), 6) AS smr FROM s JOIN r USING (lang)")
def _(t):
    d = _epi(t).where("e = 1").groupBy("lang").agg(F.sum("o").alias("events"), F.count("*").alias("pop"))
    return epi.indirect_standardise(d.join(_epi(t).groupBy("lang").agg(F.avg("o").alias("rate")), "lang"), "events", "pop", "lang", "rate")


@query("auc", f"WITH d AS ({EPI}), s AS (SELECT n_chars s, sum(o) p, sum(1-o) n FROM d GROUP BY 1), u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM s) SELECT round(sum(p*(b+n/2.0))/(sum(p)*sum(n)), 8) AS auc FROM u", 8)
def _(t):
    return one(t.spark, {"auc": epi.auc(_epi(t), "n_chars", "o")["auc"]})


@query("roc", f"WITH d AS ({EPI}), s AS (SELECT n_chars::DOUBLE s, sum(o) p, sum(1-o) n FROM d GROUP BY 1) SELECT s AS threshold, round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 8) AS fpr FROM s WINDOW w AS (ORDER BY s DESC)", 8)
def _(t):
    return epi.roc(_epi(t), "n_chars", "o")


@query("diagnostic", f"WITH c AS (SELECT sum(e*o)::DOUBLE a, sum(e*(1-o))::DOUBLE b, sum((1-e)*o)::DOUBLE c, sum((1-e)*(1-o))::DOUBLE d FROM ({EPI})), k AS (SELECT *, a/(a+c) se, d/(b+d) sp FROM c) SELECT round(se, 8) AS sensitivity, round(sp, 8) AS specificity, round(a/(a+b), 8) AS ppv, round(d/(c+d), 8) AS npv, round(se/(1-sp), 8) AS lr_plus, round((1-se)/sp, 8) AS lr_minus, round((a+d)/(a+b+c+d), 8) AS accuracy, round(se+sp-1, 8) AS youden FROM k", 8)
def _(t):
    return epi.diagnostic(epi.cells(_epi(t), "e", "o"))


@query("kappa", f"WITH d AS ({EPI}), k AS (SELECT avg((e = o)::INT) po, avg(e) pe, avg(o) q FROM d) SELECT round((po-(pe*q+(1-pe)*(1-q)))/(1-(pe*q+(1-pe)*(1-q))), 8) AS kappa, round(po, 8) AS agreement FROM k", 8)
def _(t):
    return one(t.spark, dict(zip(("kappa", "agreement"), epi.kappa(_epi(t), "e", "o"))))


@query("bland_altman", "SELECT round(avg(d), 6) AS bias, round(stddev_samp(d), 6) AS sd, round(avg(d) - 1.959963984540054*stddev_samp(d), 6) AS low, round(avg(d) + 1.959963984540054*stddev_samp(d), 6) AS high FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def _(t):
    return epi.bland_altman(t.lineitem, "l_discount", "l_tax")


@query("rate_ratio", f"WITH d AS ({EPI}), r AS (SELECT sum(o) FILTER (e = 1)::DOUBLE e1, sum(n_chars) FILTER (e = 1)::DOUBLE t1, sum(o) FILTER (e = 0)::DOUBLE e0, sum(n_chars) FILTER (e = 0)::DOUBLE t0 FROM d) SELECT round(e1/t1, 8) AS rate1, round(e0/t0, 8) AS rate0, round((e1/t1)/(e0/t0), 8) AS ratio, round((e1/t1)/(e0/t0)*exp(-1.959963984540054*sqrt(1/e1+1/e0)), 8) AS ratio_low, round((e1/t1)/(e0/t0)*exp(1.959963984540054*sqrt(1/e1+1/e0)), 8) AS ratio_high, round(e1/t1-e0/t0, 8) AS difference FROM r", 8)
def _(t):
    return epi.bradford_rate_ratio(_epi(t), "e", "o", "n_chars")


@query("e_value", "WITH r AS (SELECT avg((l_linenumber > 4)::INT) FILTER (l_quantity > 25) / avg((l_linenumber > 4)::INT) FILTER (l_quantity <= 25) AS r FROM lineitem) SELECT round(greatest(r, 1/r) + sqrt(greatest(r, 1/r)*(greatest(r, 1/r) - 1)), 6) AS e_value FROM r")
def _(t):
    share = lambda c: F.avg(F.when(c, (F.col("l_linenumber") > 4).cast("int")))
    exposed, rest = t.lineitem.agg(share(F.col("l_quantity") > 25), share(F.col("l_quantity") <= 25)).first()
    return one(t.spark, {"e_value": epi.e_value(exposed / rest)["e_value"]})


@query("fairness", "SELECT lang AS \"group\", count(*) AS n, round(avg(q), 8) AS selection_rate, round(avg(q) FILTER (toxic = 1), 8) AS tpr, round(avg(q) FILTER (toxic = 0), 8) AS fpr, round(avg((q = toxic)::INT), 8) AS accuracy FROM (SELECT lang, 1 - quality AS q, toxic FROM labels JOIN documents USING (doc_id)) GROUP BY 1", 8)
def _(t):
    return causal.fairness(t.labels.join(t.documents, "doc_id").withColumn("q", 1 - F.col("quality")), "toxic", "q", "lang")


# ---------------------------------------------------------------- surveys: orders weighted by customers, strata priority, PSU customer
SVY = "SELECT o_totalprice y, 1 + o_custkey % 3 w, o_orderpriority s, o_custkey % 50 p FROM orders"


def _svy(t: Tables):
    return t.orders.select(F.col("o_totalprice").alias("y"), (1 + F.col("o_custkey") % 3).alias("w"), F.col("o_orderpriority").alias("s"), (F.col("o_custkey") % 50).alias("p"))


@query("svy_mean", f"WITH d AS ({SVY}), m AS (SELECT sum(w*y)/sum(w) m, sum(w) sw FROM d), z AS (SELECT s, p, sum(w*(y-m)/sw) z FROM d, m GROUP BY 1, 2), v AS (SELECT s, count(*) n, var_samp(z) v FROM z GROUP BY 1) SELECT round(any_value(m), 4) AS estimate, round(sqrt(sum(n*v)), 4) AS std_error, sum(n-1)::DOUBLE AS df FROM v, m WHERE n > 1", 4)
def _(t):
    r = survey.svy(_svy(t), "y", "w", "s", "p")
    return one(t.spark, {k: r[k] for k in ("estimate", "std_error", "df")})


@query("svy_total", f"WITH d AS ({SVY}), z AS (SELECT s, p, sum(w*y) z FROM d GROUP BY 1, 2), v AS (SELECT s, count(*) n, var_samp(z) v FROM z GROUP BY 1) SELECT (SELECT round(sum(w*y), 2) FROM d) AS estimate, round(sqrt(sum(n*v)), 2) AS std_error FROM v WHERE n > 1", 2)
def _(t):
    r = survey.svy(_svy(t), "y", "w", "s", "p", kind="total")
    return one(t.spark, {k: r[k] for k in ("estimate", "std_error")})


@query("svy_ratio", f"WITH d AS (SELECT *, w * 2 AS x FROM ({SVY})) SELECT round(sum(w*y)/sum(w*x), 5) AS estimate FROM d", 5)
def _(t):
    return one(t.spark, {"estimate": survey.svy_ratio(_svy(t).withColumn("x", F.col("w") * 2), "y", "x", "w", "s", "p")["estimate"]})


@query("design_effect", f"SELECT round(count(*)*sum(w*w)/(sum(w)*sum(w)), 8) AS deff FROM ({SVY})", 8)
def _(t):
    return one(t.spark, {"deff": survey.design_effect(_svy(t), "w")})


@query("rake")
def _(t):
    d = t.orders.withColumn("odd", F.col("o_custkey") % 2)
    r = survey.rake(d, {"o_orderstatus": {"F": 0.5, "O": 0.3, "P": 0.2}, "odd": {0: 0.6, 1: 0.4}})
    return r.groupBy("o_orderstatus").agg(F.sum("raked").alias("share"))


@query("post_stratify", "SELECT o_orderstatus, round(sum(w), 6) AS total FROM (SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 100.0 WHEN 'O' THEN 200.0 ELSE 300.0 END / count(*) OVER (PARTITION BY o_orderstatus) AS w FROM orders) GROUP BY 1")
def _(t):
    r = survey.post_stratify(t.orders.withColumn("one", F.lit(1.0)), "o_orderstatus", {"F": 100, "O": 200, "P": 300}, "one")
    return r.groupBy("o_orderstatus").agg(F.sum("post_weight").alias("total"))


# ---------------------------------------------------------------- inequality
@query("gini", "WITH v AS (SELECT o_orderstatus, o_totalprice y, count(*) w FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(w) OVER (PARTITION BY o_orderstatus ORDER BY y) - w/2.0 AS mid FROM v) SELECT o_orderstatus, round(2*sum(w*y*mid)/(sum(w)*sum(w*y)) - 1, 8) AS gini FROM m GROUP BY 1", 8)
def _(t):
    return inequality.gini(t.orders, "o_totalprice", by=["o_orderstatus"])


@query("lorenz", "WITH v AS (SELECT o_totalprice y, count(*) w FROM orders GROUP BY 1), r AS (SELECT sum(w) OVER (ORDER BY y)/sum(w) OVER () AS p, sum(w*y) OVER (ORDER BY y)/sum(w*y) OVER () AS share FROM v) SELECT ceil(round(p*10, 9))::BIGINT AS bin, round(max(p), 8) AS p, round(max(share), 8) AS share FROM r GROUP BY 1", 8)
def _(t):
    return inequality.lorenz(t.orders, "o_totalprice")


@query("entropy", "WITH d AS (SELECT o_orderstatus, o_totalprice y FROM orders WHERE o_totalprice > 0) SELECT o_orderstatus, count(*)::DOUBLE AS n, round(avg(y), 4) AS mean, round(ln(avg(y)) - avg(ln(y)), 4) AS mld, round(avg(y*ln(y))/avg(y) - ln(avg(y)), 4) AS theil, round((avg(y*y)/(avg(y)*avg(y)) - 1)/2, 4) AS ge2 FROM d GROUP BY 1", 4)
def _(t):
    return inequality.entropy(t.orders, "o_totalprice", by=["o_orderstatus"])


@query("theil_decompose", "WITH g AS (SELECT o_orderstatus, count(*) n, avg(o_totalprice) m, avg(o_totalprice*ln(o_totalprice))/avg(o_totalprice) - ln(avg(o_totalprice)) t FROM orders GROUP BY 1), k AS (SELECT sum(n) nn, sum(n*m) yy FROM g) SELECT round(sum(n*m/yy*t), 8) AS within, round(sum(n*m/yy*ln(m/(yy/nn))), 8) AS between, round(sum(n*m/yy*t)+sum(n*m/yy*ln(m/(yy/nn))), 8) AS total FROM g, k", 8)
def _(t):
    return inequality.theil_decompose(t.orders, "o_totalprice", "o_orderstatus")


@query("atkinson", "SELECT round(1 - exp(avg(ln(o_totalprice)))/avg(o_totalprice), 8) AS atkinson FROM orders", 8)
def _(t):
    return inequality.atkinson(t.orders, "o_totalprice")


@query("poverty", "SELECT o_orderstatus, round(avg((o_totalprice < 100000)::INT), 8) AS headcount, round(avg(greatest(0, (100000 - o_totalprice)/100000)), 8) AS gap, round(avg(power(greatest(0, (100000 - o_totalprice)/100000), 2)), 8) AS severity FROM orders GROUP BY 1", 8)
def _(t):
    return inequality.poverty(t.orders, "o_totalprice", 100000.0, ["o_orderstatus"])


@query("source_decompose", "WITH d AS (SELECT l_discount a, l_tax b FROM lineitem) SELECT 'l_discount' AS source, round(covar_pop(a, a+b)/var_pop(a+b), 8) AS share FROM d UNION ALL SELECT 'l_tax', round(covar_pop(b, a+b)/var_pop(a+b), 8) FROM d", 8)
def _(t):
    return inequality.source_decompose(t.lineitem, ["l_discount", "l_tax"])


@query("concentration", "WITH v AS (SELECT o_custkey r, sum(o_totalprice) s, count(*) n FROM orders GROUP BY 1), m AS (SELECT *, sum(n) OVER (ORDER BY r) - n/2.0 AS mid FROM v) SELECT round(2*sum(s*mid)/(sum(n)*sum(s)) - 1, 8) AS index FROM m", 8)
def _(t):
    return one(t.spark, {"index": inequality.concentration(t.orders, "o_totalprice", "o_custkey")})


# ---------------------------------------------------------------- causal estimates on lineitem: treated is returnflag R
def _treat(t: Tables):
    return t.lineitem.select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("t"), F.col("l_discount").alias("x"), F.col("l_quantity").alias("q"), (F.col("l_quantity") > 25).cast("double").alias("b"), (F.col("l_linestatus") == "O").cast("double").alias("m"))


TREAT = "SELECT l_extendedprice y, (l_returnflag = 'R')::INT t, (l_quantity > 25)::INT b, (l_linestatus = 'O')::INT m FROM lineitem"


@query("ipw_ate", f"WITH d AS ({TREAT}), p AS (SELECT b, avg(t) e FROM d GROUP BY b), w AS (SELECT d.*, e FROM d JOIN p USING (b)) SELECT round(sum(t*y/e)/sum(t/e) - sum((1-t)*y/(1-e))/sum((1-t)/(1-e)), 4) AS estimate FROM w", 4)
def _(t):
    return one(t.spark, {"estimate": causal.ipw(_treat(t), "y", "t", ["b"])["estimate"]})


@query("ipw_att", f"WITH d AS ({TREAT}), p AS (SELECT b, avg(t) e FROM d GROUP BY b), w AS (SELECT d.*, e FROM d JOIN p USING (b)) SELECT round(avg(y) FILTER (t = 1) - sum((1-t)*y*e/(1-e))/sum((1-t)*e/(1-e)), 4) AS estimate FROM w", 4)
def _(t):
    return one(t.spark, {"estimate": causal.ipw(_treat(t), "y", "t", ["b"], estimand="ATT")["estimate"]})


@query("g_computation", f"WITH d AS ({TREAT}), c AS (SELECT b, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS g, count(*) n FROM d GROUP BY b) SELECT round(sum(n*g)/sum(n), 4) AS estimate FROM c", 4)
def _(t):
    return one(t.spark, {"estimate": causal.g_computation(_treat(t), "y", "t", ["b"])["estimate"]})


@query("aipw")
def _(t):
    return one(t.spark, causal.aipw(_treat(t), "y", "t", ["x", "q"], "k"))


@query("dml_plr")
def _(t):
    return one(t.spark, causal.dml_plr(_treat(t), "y", "t", ["x", "q"], "k"))


@query("meta_learner_t", f"WITH d AS ({TREAT}) SELECT b::DOUBLE AS b, round(avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0), 4) AS cate FROM d GROUP BY b", 4)
def _(t):
    return causal.meta_learner(_treat(t), "y", "t", ["b"], "t").groupBy("b").agg(F.avg("cate").alias("cate"))


for _kind in ("s", "x", "r", "dr"):

    @query(f"meta_learner_{_kind}")
    def _(t, kind=_kind):
        return causal.meta_learner(_treat(t), "y", "t", ["x", "q"], kind).agg(F.avg("cate").alias("mean"), F.stddev("cate").alias("sd"))


@query("entropy_balance", f"WITH d AS ({TREAT}) SELECT round(avg(y) FILTER (t = 1) - ((SELECT avg(b) FROM d WHERE t = 1) * avg(y) FILTER (t = 0 AND b = 1) + (1 - (SELECT avg(b) FROM d WHERE t = 1)) * avg(y) FILTER (t = 0 AND b = 0)), 4) AS att FROM d", 4)
def _(t):
    d = causal.entropy_balance(_treat(t), "t", ["b"], keep=("y",))
    m = lambda v: F.sum(F.when(F.col("t") == v, F.col("weight") * F.col("y"))) / F.sum(F.when(F.col("t") == v, F.col("weight")))
    return d.agg((m(1) - m(0)).alias("att"))


@query("psm")
def _(t):
    return one(t.spark, causal.att_by_matching(_treat(t), "y", "t", ["x", "q"], "k"))


@query("manski_bounds", f"WITH d AS ({TREAT}), k AS (SELECT min(y) lo, max(y) hi, avg(t) p, avg(y) FILTER (t = 1) m1, avg(y) FILTER (t = 0) m0 FROM d) SELECT round(m1*p + lo*(1-p) - m0*(1-p) - hi*p, 4) AS lower, round(m1*p + hi*(1-p) - m0*(1-p) - lo*p, 4) AS upper FROM k", 4)
def _(t):
    return one(t.spark, causal.manski(_treat(t), "y", "t"))


@query("lee_bounds", f"""WITH d AS ({TREAT}), r AS (SELECT t, avg(m) p, count(*) FILTER (m = 1) n, avg(y) FILTER (m = 1) mean FROM d GROUP BY t), k AS (SELECT arg_max(t, (p, t)) more, max(p) hi, min(p) lo, arg_max(n, (p, t)) n, arg_min(mean, (p, t)) other FROM r), q AS (SELECT *, floor(lo/hi*n) keep FROM k),
s AS (SELECT y, row_number() OVER (ORDER BY y) a, row_number() OVER (ORDER BY y DESC) b FROM d, q WHERE m = 1 AND t = more), g AS (SELECT sum(y) FILTER (a <= keep)/any_value(keep) l, sum(y) FILTER (b <= keep)/any_value(keep) u FROM s, q)
SELECT round(CASE WHEN more = 1 THEN least(l, u) - other ELSE other - greatest(l, u) END, 4) AS lower, round(CASE WHEN more = 1 THEN greatest(l, u) - other ELSE other - least(l, u) END, 4) AS upper FROM g, q""", 4)
def _(t):
    r = causal.lee(_treat(t), "y", "t", "m")
    return one(t.spark, {k: r[k] for k in ("lower", "upper")})


@query("balke_pearl")
def _(t):
    return one(t.spark, causal.balke_pearl(_treat(t), "b", "t", "m"))


@query("oster")
def _(t):
    return one(t.spark, causal.oster(_treat(t), "y", "t", ["q", "x"]))


@query("mediation", "WITH d AS (SELECT (l_returnflag = 'R')::INT t, l_quantity m, l_extendedprice y FROM lineitem), s AS (SELECT covar_pop(t,m) tm, var_pop(t) tt, var_pop(m) mm, covar_pop(t,y) ty, covar_pop(m,y) my FROM d), k AS (SELECT tm/tt a, (tt*my-tm*ty)/(tt*mm-tm*tm) b, (mm*ty-tm*my)/(tt*mm-tm*tm) c FROM s) SELECT round(a*b, 5) AS indirect, round(c, 5) AS direct, round(a*b+c, 5) AS total FROM k", 5)
def _(t):
    r = causal.mediation(_treat(t), "y", "t", "q")
    return one(t.spark, {k: r[k] for k in ("indirect", "direct", "total")})


@query("front_door", f"WITH d AS ({TREAT}), c AS (SELECT m, t, count(*) n, avg(y) y FROM d GROUP BY 1, 2), a AS (SELECT t, sum(n) nt FROM c GROUP BY 1), j AS (SELECT m, t, n/nt pm, y*nt/(SELECT sum(n) FROM c) w FROM c JOIN a USING (t)), k AS (SELECT m, coalesce(sum(pm) FILTER (t = 1), 0) - coalesce(sum(pm) FILTER (t = 0), 0) g, sum(w) w FROM j GROUP BY m) SELECT round(sum(g*w), 5) AS effect FROM k", 5)
def _(t):
    return one(t.spark, {"effect": causal.front_door(_treat(t), "y", "t", "m")})


@query("late", f"WITH d AS ({TREAT}) SELECT round(covar_pop(y, m)/covar_pop(t, m), 3) AS late, round(covar_pop(t, m)/var_pop(m), 3) AS first_stage FROM d", 3)
def _(t):
    r = causal.wald_late(_treat(t), "y", "t", "m")
    return one(t.spark, {k: r[k] for k in ("late", "first_stage")})


@query("policy_value", "WITH d AS (SELECT o_totalprice r, CASE WHEN o_orderstatus = 'F' THEN 2.0 ELSE 0 END w FROM orders) SELECT round(avg(w*r), 4) AS ips, round(sum(w*r)/sum(w), 4) AS snips, round(stddev_samp(w*r)/sqrt(count(*)), 4) AS std_error, round(sum(w)*sum(w)/sum(w*w), 4) AS effective_n FROM d", 4)
def _(t):
    return one(t.spark, causal.policy_value(t.orders.withColumn("p", F.lit(0.5)), "o_totalprice", "o_orderstatus", "p", F.lit("F")))


@query("targeting", "WITH r AS (SELECT c_acctbal e, row_number() OVER (ORDER BY c_acctbal DESC) k, count(*) OVER () n, avg(c_acctbal) OVER () m FROM customer), f AS (SELECT unnest([0.1, 0.25, 0.5])::DOUBLE f) SELECT f AS fraction, floor(f*any_value(n))::BIGINT AS budget, round(sum(e) FILTER (k <= floor(f*n) AND e > 0), 4) AS gain, round(floor(f*any_value(n))*any_value(m), 4) AS random FROM r, f GROUP BY f", 4)
def _(t):
    return causal.targeting(t.customer, "c_acctbal")


# ---------------------------------------------------------------- discontinuities on order prices
def _rd(t: Tables):
    return t.orders.select(((F.col("o_totalprice") - 250000) / 100000).alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("d"))


@query("rd_local_mean", "WITH d AS (SELECT (o_totalprice-250000)/100000 x, o_custkey % 97 y FROM orders) SELECT round(avg(y) FILTER (x >= 0) - avg(y) FILTER (x < 0), 6) AS estimate, round(sqrt(var_samp(y) FILTER (x >= 0)/count(*) FILTER (x >= 0) + var_samp(y) FILTER (x < 0)/count(*) FILTER (x < 0)), 6) AS std_error FROM d WHERE abs(x) <= 0.2")
def _(t):
    r = rd.local_randomisation(_rd(t), "y", "x", 0.0, 0.2)
    return one(t.spark, {k: r[k] for k in ("estimate", "std_error")})


@query("rd_sharp", """WITH d AS (SELECT (o_totalprice-250000)/100000 x, o_custkey % 97 y FROM orders), f AS (SELECT x, y, x >= 0 s, 1-abs(x)/0.5 w FROM d WHERE abs(x) < 0.5),
k AS (SELECT s, (sum(w*x*x)*sum(w*y) - sum(w*x)*sum(w*x*y)) / (sum(w)*sum(w*x*x) - sum(w*x)*sum(w*x)) a FROM f GROUP BY s) SELECT round(sum(CASE WHEN s THEN a ELSE -a END), 5) AS estimate FROM k""", 5)
def _(t):
    return one(t.spark, {"estimate": rd.rd(_rd(t), "y", "x", bandwidth=0.5)["estimate"]})


@query("rd_fuzzy")
def _(t):
    return one(t.spark, rd.rd(_rd(t), "y", "x", bandwidth=1.0, fuzzy="d"))


@query("rd_kink")
def _(t):
    return one(t.spark, rd.rd(_rd(t), "y", "x", bandwidth=1.0, order=2, derivative=1))


@query("rd_plot", "WITH d AS (SELECT (o_totalprice-250000)/100000 x, (o_custkey % 97)::DOUBLE y FROM orders), m AS (SELECT min(x) lo, max(x) hi FROM d) SELECT (x >= 0)::INT AS side, CASE WHEN x >= 0 THEN least(floor(x/(hi/20)), 19) ELSE greatest(floor(x/(-lo/20)), -20) END::BIGINT AS bin, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM d, m GROUP BY 1, 2")
def _(t):
    return rd.rd_plot(_rd(t), "y", "x")


@query("rd_density")
def _(t):
    return one(t.spark, rd.density_test(_rd(t), "x"))


@query("bunching")
def _(t):
    return one(t.spark, rd.bunching(t.orders, "o_totalprice", 250000.0, 4000.0))


# ---------------------------------------------------------------- resampling and multiple tests
@query("bootstrap_mean")
def _(t):
    d = t.orders
    draws = resample.bootstrap(d, resample.weighted_mean("o_totalprice"), ["o_orderkey"], 100)
    return one(t.spark, resample.summary(draws, d.agg(F.avg("o_totalprice")).first()[0]))


@query("permutation_test")
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("t"))
    return one(t.spark, resample.permutation(d, "o_totalprice", "t", "o_orderkey", replicates=100))


@query("jackknife", "WITH c AS (SELECT o_custkey, sum(o_totalprice) s, count(*) n FROM orders GROUP BY 1), k AS (SELECT sum(s) ss, sum(n) nn, count(*) g FROM c) SELECT round(any_value(ss)/any_value(nn), 4) AS estimate, round(sqrt((any_value(g)-1)/any_value(g) * sum(power((ss-s)/(nn-n) - ss/nn, 2))), 4) AS std_error, any_value(g)::DOUBLE AS clusters FROM c, k", 4)
def _(t):
    return one(t.spark, resample.jackknife_mean(t.orders, "o_totalprice", "o_custkey"))


PV = "SELECT l_suppkey, 1.0 / (1 + count(*)) AS p FROM lineitem GROUP BY 1"


def _pv(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg((1.0 / (1 + F.count("*"))).alias("p"))


@query("adjust_bonferroni", f"SELECT l_suppkey, round(p, 9) AS p, round(least(p * count(*) OVER (), 1), 9) AS p_adjusted FROM ({PV})", 9)
def _(t):
    return resample.adjust(_pv(t), "p", "bonferroni")


@query("adjust_holm", f"WITH d AS ({PV}), r AS (SELECT *, row_number() OVER (ORDER BY p) k, count(*) OVER () n FROM d) SELECT l_suppkey, round(p, 9) AS p, round(least(max(p*(n-k+1)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 1), 9) AS p_adjusted FROM r", 9)
def _(t):
    return resample.adjust(_pv(t).withColumn("p", F.col("p") + F.col("l_suppkey") * 0), "p", "holm")


@query("adjust_bh", f"WITH d AS ({PV}), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () n FROM d) SELECT l_suppkey, round(p, 9) AS p, round(least(min(p*n/k) OVER (ORDER BY p DESC), 1), 9) AS p_adjusted FROM r", 9)
def _(t):
    return resample.adjust(_pv(t), "p", "bh")


@query("fisher_combined", f"SELECT round(sum(-2*ln(p)), 6) AS fisher FROM ({PV})")
def _(t):
    return one(t.spark, {"fisher": resample.combine_p(_pv(t), "p")["fisher"]})


@query("sequential_test")
def _(t):
    return resample.sequential_test(t.lineitem.withColumn("m", F.year("l_shipdate")), "l_discount", "m", 0.01)


# ---------------------------------------------------------------- series and pooled estimates
@query("its")
def _(t):
    d = t.lineitem.select("l_extendedprice", F.floor(F.months_between("l_shipdate", F.lit("1995-01-01"))).alias("m"))
    return series.interrupted(d, "l_extendedprice", "m", 40).frame(t.spark).select("term", "estimate", "std_error")


@query("local_projection")
def _(t):
    d = t.lineitem.select("l_extendedprice", "l_quantity", F.floor(F.months_between("l_shipdate", F.lit("1995-01-01"))).alias("m"))
    return series.local_projection(d, "l_extendedprice", "l_quantity", "m", 4)


@query("acf", """WITH s AS (SELECT date_trunc('month', l_shipdate) m, avg(l_extendedprice) y FROM lineitem GROUP BY 1), z AS (SELECT m, y - avg(y) OVER () AS z, count(*) OVER () n FROM s), v AS (SELECT sum(z*z) v FROM z), l AS (SELECT k AS lag, z, lag(z, k) OVER (PARTITION BY k ORDER BY m) AS p FROM z, (SELECT unnest([1, 2, 3]) AS k))
SELECT lag, round(sum(z*p)/any_value(v), 6) AS acf FROM l, v GROUP BY lag""")
def _(t):
    return series.autocorrelation(t.lineitem.withColumn("m", F.trunc("l_shipdate", "month")), "l_extendedprice", "m", 3).select("lag", "acf")


@query("granger")
def _(t):
    d = t.lineitem.withColumn("m", F.trunc("l_shipdate", "month"))
    return one(t.spark, dict(zip(("f", "p"), series.granger(d, "l_extendedprice", "l_quantity", "m"))))


EFFECTS = "SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag = 'N') AS e, sqrt(var_samp(l_extendedprice) FILTER (l_returnflag = 'R')/count(*) FILTER (l_returnflag = 'R') + var_samp(l_extendedprice) FILTER (l_returnflag = 'N')/count(*) FILTER (l_returnflag = 'N')) AS s FROM lineitem GROUP BY 1"


def _effects(t: Tables):
    y = F.col("l_extendedprice")
    r, n = F.when(F.col("l_returnflag") == "R", y), F.when(F.col("l_returnflag") == "N", y)
    return t.lineitem.groupBy("l_suppkey").agg((F.avg(r) - F.avg(n)).alias("e"), F.sqrt(F.var_samp(r) / F.count(r) + F.var_samp(n) / F.count(n)).alias("s"))


@query("meta_analysis", f"WITH d AS ({EFFECTS}), a AS (SELECT count(*) n, sum(1/(s*s)) w, sum(e/(s*s)) we, sum(e*e/(s*s)) wee, sum(1/(s*s*s*s)) ww FROM d), q AS (SELECT *, wee - we*we/w AS q FROM a), t AS (SELECT *, greatest((q-(n-1))/(w-ww/w), 0) AS tau2 FROM q) SELECT round(any_value(we/w), 4) AS fixed, round(sqrt(1/any_value(w)), 4) AS fixed_se, round(sum(e/(s*s+tau2))/sum(1/(s*s+tau2)), 4) AS random, round(any_value(q), 4) AS q FROM d, t", 4)
def _(t):
    r = series.meta(_effects(t), "e", "s")
    return one(t.spark, {k: r[k] for k in ("fixed", "fixed_se", "random", "q")})


@query("mendelian")
def _(t):
    d = _effects(t).withColumn("x", 1.0 + F.col("l_suppkey") % 5)
    return one(t.spark, series.mr(d, "x", "e", "s"))


@query("icc", "WITH c AS (SELECT l_suppkey, count(*) n, avg(l_extendedprice) m, var_pop(l_extendedprice) v FROM lineitem GROUP BY 1), g AS (SELECT sum(n*m)/sum(n) g, count(*) k, sum(n) nn, sum(n*n) n2, sum(n*v) ss FROM c), b AS (SELECT sum(n*(m-g)*(m-g))/(any_value(k)-1) b, any_value(ss)/(any_value(nn)-any_value(k)) w, (any_value(nn)-any_value(n2)/any_value(nn))/(any_value(k)-1) n0 FROM c, g) SELECT round((b-w)/(b+(n0-1)*w), 8) AS icc FROM b", 8)
def _(t):
    return one(t.spark, {"icc": series.icc(t.lineitem, "l_extendedprice", "l_suppkey")})


@query("power")
def _(t):
    sd, n = t.orders.agg(F.stddev("o_totalprice"), F.count("*")).first()
    return one(t.spark, {"power": series.power_means(0.02 * sd, sd, n // 2), "n": series.sample_size(0.02 * sd, sd), "mde": series.minimum_effect(sd, n // 2)})


@query("synthetic_control")
def _(t):
    d = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("u"), F.year("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("y"))
    first = d.agg(F.min("u")).first()[0]
    r = series.synthetic_control(d, "y", "u", "t", first, 1999)
    return one(t.spark, {k: r[k] for k in ("att", "p_value", "pre_rmse")})
