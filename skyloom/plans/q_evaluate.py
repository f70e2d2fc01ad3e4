"""Checked queries: evaluation measures, rating statistics, sample quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import arrays as ar
from skyloom.operators import evaluate as ev
from skyloom.operators.resample import mean_ci
from skyloom.plans.q_features import rounded
from skyloom.plans.q_scalars import SOFT
from skyloom.registry import query
from skyloom.sources.tables import PRED, PROBS, RATE, folds, folds_sql

CONF = f"WITH {PRED}, c AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2), l AS (SELECT actual AS v FROM pred UNION SELECT predicted FROM pred)"


@query("ev_01_confusion_matrix", f"{CONF} SELECT a.v AS actual, b.v AS predicted, coalesce(c.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v")
def confusion(t):
    return ev.confusion_matrix(t.pred, "actual", "predicted")


@query("ev_04_misclassification", f"{CONF} SELECT a.v AS actual, b.v AS predicted, CASE WHEN a.v = b.v THEN 0 ELSE coalesce(c.n, 0) END AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v")
def misclassification(t):
    return ev.confusion_matrix(t.pred, "actual", "predicted", errors_only=True)


@query("ev_01_confusion_seen_pairs", "SELECT l_partkey AS actual, l_suppkey AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2")
def confusion_seen(t):
    """Thousands of labels: only the pairs that occur."""
    return ev.confusion_matrix(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", all_pairs=False)


@query("ev_04_misclassification_seen_pairs", "SELECT l_partkey AS actual, l_suppkey AS predicted, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def misclassification_seen(t):
    return ev.confusion_matrix(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", errors_only=True, all_pairs=False)


_GIVEN = "(VALUES (0), (1), (2), (99)) l(v)"


@query("ev_01_confusion_given_labels", f"""WITH {PRED}, c AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2), l AS (SELECT v FROM {_GIVEN})
SELECT a.v AS actual, b.v AS predicted, coalesce(c.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v""")
def confusion_given(t):
    df = t.pred.withColumns({c: F.col(c).cast("int") for c in ("actual", "predicted")})
    return ev.confusion_matrix(df, "actual", "predicted", labels=[0, 1, 2, 99])


def class_sql(by=""):
    g = f"{by}, " if by else ""
    match = f"p.{by} = k.{by} AND " if by else ""
    return f"""WITH {PRED}, k AS (SELECT {g}actual AS label FROM pred UNION SELECT {g}predicted FROM pred),
 m AS (SELECT {f'k.{by}, ' if by else ''}k.label, CAST(count(*) FILTER (actual = label AND predicted = label) AS DOUBLE) AS tp, count(*) FILTER (actual = label AND predicted <> label) AS fn,
  count(*) FILTER (actual <> label AND predicted = label) AS fp, count(*) FILTER (actual <> label AND predicted <> label) AS tn, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS acc
  FROM k JOIN pred p ON {match}true GROUP BY ALL)
SELECT {g}label, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
 round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 4) AS specificity, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS tpr,
 round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END, 4) AS fpr, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1,
 round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 4) AS balanced_accuracy,
 CAST(tp + fn AS BIGINT) AS support, round(acc, 4) AS accuracy FROM m"""


@query("ev_02_class_metrics", class_sql())
def class_metrics(t):
    return ev.class_metrics(t.pred, "actual", "predicted")


@query("ev_08_class_metrics_by_station", class_sql("stationid"))
def class_metrics_by(t):
    return ev.class_metrics(t.pred, "actual", "predicted", ["stationid"])


@query("ev_08_tidy_metrics", f"""WITH m AS ({class_sql()}) SELECT label, metric, CAST(value AS DOUBLE) AS value FROM (SELECT label, precision, recall, balanced_accuracy FROM m) UNPIVOT (value FOR metric IN (precision, recall, balanced_accuracy))""")
def tidy(t):
    return ev.tidy_metrics(ev.class_metrics(t.pred, "actual", "predicted").select("label", "precision", "recall", "balanced_accuracy"), ["label"])


@query("ev_03_mismatches", f"WITH {PRED} SELECT id, actual, predicted FROM pred WHERE actual <> predicted")
def mismatches(t):
    return ev.mismatches(t.pred, "actual", "predicted").select("id", "actual", "predicted")


@query("ev_03_error_counts", f"WITH {PRED} SELECT actual, count(*) AS errors FROM pred WHERE actual <> predicted GROUP BY 1")
def error_counts(t):
    return ev.error_counts(t.pred, "actual", "predicted")


@query("ev_05_correct_share", f"WITH {PRED} SELECT actual, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS correct, round(avg(CASE WHEN actual <> predicted THEN 1.0 ELSE 0.0 END), 6) AS incorrect FROM pred GROUP BY 1")
def correct_share(t):
    return rounded(ev.correct_share(t.pred, "actual", "predicted"))


ACT, PRB = (0.5, 10, 30), (0.1, 0.15, 0.2, 0.3, 0.5, 0.7)
GRID = f"""WITH {PRED}, ta AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in ACT)}]) AS ta), tp AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in PRB)}]) AS tp),
 g AS (SELECT ta AS actual_threshold, tp AS prob_threshold, count(*) FILTER (measured >= ta AND prob >= tp) AS a, count(*) FILTER (prob >= tp) AS p, count(*) FILTER (measured >= ta) AS c FROM pred, ta, tp GROUP BY 1, 2),
 grid AS (SELECT actual_threshold, prob_threshold, CASE WHEN p > 0 THEN a / p END AS precision, CASE WHEN c > 0 THEN a / c END AS recall FROM g)"""


@query("ev_06_threshold_grid", f"{GRID} SELECT actual_threshold, prob_threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM grid")
def threshold_grid(t):
    return rounded(ev.threshold_grid(t.pred, "measured", "prob", ACT, PRB))


@query("ag_15_grid_medians", f"{GRID}, m AS (SELECT prob_threshold, median(precision) AS p, median(recall) AS r FROM grid GROUP BY 1) SELECT prob_threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(sqrt(p * p + r * r), 6) AS combined FROM m")
def grid_medians(t):
    return rounded(ev.grid_medians(ev.threshold_grid(t.pred, "measured", "prob", ACT, PRB)))


@query("ev_07_binary_summary", f"""WITH {PRED}, c AS (SELECT stationid, count(*) FILTER (actual <> 0 AND predicted <> 0) AS tp, count(*) FILTER (actual = 0 AND predicted <> 0) AS fp,
 count(*) FILTER (actual <> 0 AND predicted = 0) AS fn, count(*) FILTER (actual = 0 AND predicted = 0) AS tn FROM pred GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c""")
def binary_summary(t):
    return rounded(ev.binary_summary(t.pred, "actual", "predicted", ["stationid"]))


@query("ev_09_regression_metrics", f"""WITH {PRED}, s AS (SELECT stationid, avg(pow(estimate - measured, 2)) AS m FROM pred GROUP BY 1)
SELECT round(avg(pow(estimate - measured, 2)), 8) AS mse, round(avg(abs(estimate - measured)), 8) AS mae, round(sqrt(avg(pow(estimate - measured, 2))), 8) AS rmse, (SELECT round(avg(sqrt(m)), 8) FROM s) AS forecast_rmse FROM pred""")
def regression(t):
    return rounded(ev.regression_metrics(t.pred, "measured", "estimate", ["stationid"]), 8)


@query("ev_09_masked", """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT round(avg(pow(value - 10, 2)), 6) AS mse, round(avg(abs(value - 10)), 6) AS mae FROM n WHERE pos < user_id % 9 + 3""")
def regression_masked(t):
    from skyloom.plans.q_features import RAW
    from skyloom.slicing import with_ordinal

    df = with_ordinal(t.seq, ["user_id"], ["ts", "event_id"], RAW("ts")).withColumns(
        {"pos": F.col("pos") - 1, "length": F.col("user_id") % 9 + 3, "guess": F.lit(10.0)}
    )
    return rounded(ev.regression_metrics(ev.masked(df, "pos", "length"), "guess", "value").select("mse", "mae"))


@query("ev_10_accuracy", f"WITH {SOFT}, r AS (SELECT vec_id, max(i - 1) FILTER (rn = 1) AS top1, bool_or(rn <= 3 AND i - 1 = label) AS in3, any_value(label) AS label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM soft) GROUP BY 1) SELECT round(avg(CASE WHEN top1 = label THEN 1.0 ELSE 0 END), 6) AS accuracy_at_1, round(avg(CASE WHEN in3 THEN 1.0 ELSE 0 END), 6) AS accuracy_at_3 FROM r")
def accuracy(t):
    one, three = ev.accuracy(t.probs, "scores", "label", 1), ev.accuracy(t.probs, "scores", "label", 3)
    return rounded(one.withColumn("accuracy_at_3", three.scalar()))


@query("ev_10_binary_accuracy", "SELECT round(avg(CASE WHEN (list_sum([CAST(v AS DOUBLE) FOR v IN embedding]) >= 0) = (label >= 5) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM embeddings")
def binary_accuracy(t):
    df = t.embeddings.select(folds("embedding", 1)[0].alias("x"), (F.col("label") >= 5).cast("int").alias("y"))
    return rounded(ev.binary_accuracy(df, "x", "y"))


@query("ev_11_f1", f"""WITH {PRED}, k AS (SELECT DISTINCT label FROM (SELECT actual AS label FROM pred UNION SELECT predicted FROM pred)),
 m AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual = label AND predicted <> label) AS fn, count(*) FILTER (actual <> label AND predicted = label) AS fp FROM k, pred GROUP BY 1)
SELECT 'binary' AS average, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m WHERE label = 1 UNION ALL SELECT 'macro', round(avg(2 * tp / (2 * tp + fp + fn)), 6) FROM m
UNION ALL SELECT 'micro', round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM m""")
def f1(t):
    parts = [ev.f1(t.pred, "actual", "predicted", a).select(F.lit(a).alias("average"), F.round("f1", 6).alias("f1")) for a in ("binary", "macro", "micro")]
    return parts[0].union(parts[1]).union(parts[2])


@query("ev_12_roc_auc", f"""WITH {PRED}, s AS (SELECT prob, count(*) FILTER (actual >= 3) AS p, count(*) FILTER (actual < 3) AS n FROM pred GROUP BY 1),
 c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(CAST(sum(p * (below + n / 2)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c""")
def roc_auc(t):
    return rounded(ev.roc_auc(t.pred.withColumn("y", (F.col("actual") >= 3).cast("int")), "prob", "y"))


@query("ev_13_log_loss", f"""WITH {SOFT}, l AS (SELECT vec_id, any_value(label) AS label, ln(sum(exp(s))) AS lse, avg(s) AS mean_s, max(s) FILTER (i - 1 = label) AS own FROM soft GROUP BY 1)
SELECT round(avg(lse - own), 6) AS loss, round(avg(0.9 * (lse - own) + 0.1 * (lse - mean_s)), 6) AS smooth, round(exp(avg(lse - own)), 6) AS perplexity, round(avg(lse - own) / ln(2), 6) AS bits_per_byte FROM l""")
def log_loss(t):
    loss = ev.log_loss(t.probs, "scores", "label")
    return rounded(loss.withColumns({
        "smooth": ev.log_loss(t.probs, "scores", "label", 0.1).scalar(), "perplexity": ev.perplexity(loss).scalar(),
        "bits_per_byte": ev.bits_per_byte(loss).scalar(),
    }))


@query("ev_13_binary_log_loss", "SELECT round(avg(ln(1 + exp(x)) - x * y), 6) AS loss FROM (SELECT list_sum([CAST(v AS DOUBLE) FOR v IN embedding]) * 4 AS x, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y FROM embeddings)")
def binary_log_loss(t):
    df = t.embeddings.select((folds("embedding", 1)[0] * 4).alias("x"), (F.col("label") >= 5).cast("double").alias("y"))
    return rounded(ev.binary_log_loss(df, "x", "y"))


NLL = f"f AS (SELECT {folds_sql('embedding', 4)} AS e FROM embeddings), x AS (SELECT e[1] AS mu, ln(1 + exp(e[2])) AS s, 2 + ln(1 + exp(e[3])) AS v, e[4] AS y FROM f)"


def nll_frame(t):
    e = F.col("e")
    return t.embeddings.select(folds("embedding", 4).alias("e")).select(*[e[i].alias(n) for i, n in enumerate(("mu", "sigma", "nu", "y"))])


@query("ev_14_gaussian_nll", f"WITH {NLL} SELECT round(avg(ln(s) + 0.5 * ln(2 * pi()) + 0.5 * pow((y - mu) / s, 2)), 6) AS nll FROM x")
def gaussian(t):
    return rounded(ev.gaussian_nll(nll_frame(t), "mu", "sigma", "y"))


@query("ev_14_student_t_nll", f"WITH {NLL} SELECT round(avg(-(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(pi() * v) - ln(s) - (v + 1) / 2 * ln(1 + pow((y - mu) / s, 2) / v))), 6) AS nll FROM x")
def student(t):
    return rounded(ev.student_t_nll(nll_frame(t), "mu", "sigma", "nu", "y"))


@query("ev_22_iou", f"WITH {PRED} SELECT round((sum(y * h) + 1e-7) / (sum(y) + sum(h) - sum(y * h) + 1e-7), 6) AS iou FROM (SELECT CASE WHEN actual >= 3 THEN 1.0 ELSE 0.0 END AS y, CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END AS h FROM pred)")
def iou(t):
    return rounded(ev.iou(t.pred.withColumn("y", (F.col("actual") >= 3).cast("double")), "prob", "y"))


@query("ev_22_focal_loss", """WITH x AS (SELECT list_sum([CAST(v AS DOUBLE) FOR v IN embedding]) * 4 AS x, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y FROM embeddings), c AS (SELECT y, ln(1 + exp(x)) - x * y AS ce FROM x)
SELECT round(avg(pow(1 - exp(-ce), 2) * ce * (0.25 * y + 0.75 * (1 - y))), 6) AS loss FROM c""")
def focal(t):
    df = t.embeddings.select((folds("embedding", 1)[0] * 4).alias("x"), (F.col("label") >= 5).cast("int").alias("y"))
    return rounded(ev.focal_loss(df, "x", "y"))


# --- raters --------------------------------------------------------------------------------------------------------
@query("ev_19_opinion_score", f"""WITH {RATE} SELECT method, round(avg(quality), 6) AS mean, count(quality) AS count, round(stddev_samp(quality), 6) AS std,
 round(avg(quality) - 1.96 * stddev_samp(quality) / sqrt(count(quality) / 10.0), 6) AS lo, round(avg(quality) + 1.96 * stddev_samp(quality) / sqrt(count(quality) / 10.0), 6) AS hi FROM rate GROUP BY 1""")
def opinion(t):
    return rounded(mean_ci(t.rate, ["method"], "quality", 10.0))


@query("ev_20_screen_raters", f"""WITH {RATE}, c AS (SELECT DISTINCT method, item FROM rate WHERE method = 'click' AND item < 3), b AS (SELECT DISTINCT worker FROM rate JOIN c USING (method, item) WHERE quality > 4)
SELECT worker, method, item, quality, event_id FROM rate r WHERE worker NOT IN (SELECT worker FROM b) AND NOT EXISTS (SELECT 1 FROM c WHERE c.method = r.method AND c.item = r.item)""")
def screen(t):
    controls = t.rate.where("method = 'click' AND item < 3").select("method", "item").distinct().withColumn("max_quality", F.lit(4))
    return ev.screen_raters(t.rate, controls)


@query("ev_21_cohen_kappa", f"""WITH {PRED}, n AS (SELECT stationid, count(*) AS n, count(*) FILTER (actual = predicted) / count(*) AS po FROM pred GROUP BY 1),
 a AS (SELECT stationid, actual AS l, count(*) AS c FROM pred GROUP BY 1, 2), b AS (SELECT stationid, predicted AS l, count(*) AS c FROM pred GROUP BY 1, 2),
 e AS (SELECT a.stationid, CAST(sum(a.c * b.c) AS DOUBLE) AS e FROM a JOIN b ON a.stationid = b.stationid AND a.l = b.l GROUP BY 1)
SELECT n.stationid, n, round(po, 6) AS agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n JOIN e ON n.stationid = e.stationid""")
def kappa(t):
    return rounded(ev.cohen_kappa(t.pred, "actual", "predicted", ["stationid"]))


@query("ev_23_rating_batches", """WITH i AS (SELECT DISTINCT event_id % 50 AS item FROM events), s AS (SELECT item, (row_number() OVER (ORDER BY md5(concat_ws('|', CAST(item AS VARCHAR), '42')), item) - 1) // 10 AS batch FROM i),
 m AS (SELECT item, CAST(batch AS BIGINT) AS batch, method, md5(concat_ws('|', method, CAST(item AS VARCHAR), '42')) AS uid FROM s, (VALUES ('a'), ('b'), ('c')) v(method))
SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY uid) AS INTEGER) AS place FROM m""")
def batches(t):
    return ev.rating_batches(t.rate, "item", ["a", "b", "c"], 10, 42)


@query("ev_23_unequal_methods", f"WITH {RATE} SELECT method, count(DISTINCT item) AS items FROM rate WHERE NOT (method = 'click' AND item = 7) GROUP BY 1 HAVING count(DISTINCT item) < 50")
def unequal(t):
    return ev.unequal_methods(t.rate.where("NOT (method = 'click' AND item = 7)"), "method", "item")


# --- sample quality ------------------------------------------------------------------------------------------------
HALF = f"""{SOFT}, h AS (SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', CAST(vec_id AS VARCHAR), '1')), vec_id) <= (SELECT count(*) FROM embeddings) // 2 THEN 1 ELSE 2 END AS half FROM embeddings),
 sh AS (SELECT s.vec_id, i, p, half FROM soft s JOIN h ON s.vec_id = h.vec_id)"""


def soft_frame(t):
    return t.probs.select("vec_id", "label", ar.softmax("scores").alias("p"))


@query("ev_16a_inception_score", f"""WITH {HALF}, m AS (SELECT i, avg(p) AS q FROM sh WHERE half = 2 GROUP BY 1), mq AS (SELECT i, q / (SELECT sum(q) FROM m) AS q FROM m),
 d AS (SELECT vec_id, sum(p * ln(p / q)) AS d FROM sh JOIN mq USING (i) WHERE half = 1 GROUP BY 1) SELECT round(exp(avg(d)), 6) AS score FROM d""")
def inception(t):
    return rounded(ev.inception_score(soft_frame(t), "p", ["vec_id"], 1))


@query("ev_16a_inception_score_by_class", f"""WITH {HALF}, c AS (SELECT i, sum(p) AS s, sum(p * ln(p)) AS e, count(*) AS n FROM sh WHERE half = 1 GROUP BY 1) SELECT round(exp(avg(e / s - ln(s) + ln(n))), 6) AS score FROM c""")
def inception_class(t):
    return rounded(ev.inception_score(soft_frame(t), "p", ["vec_id"], 1, axis="class"))


@query("ev_16b_modified_inception_score", f"""WITH {SOFT}, z AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(vec_id AS VARCHAR), '0')), vec_id) AS no, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
 w AS (SELECT id, {', '.join(f"CAST(('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), '0-{s}')), 1, 12)) AS BIGINT) % (SELECT max(n) FROM z) + 1 AS {s}" for s in 'ab')} FROM generate_series(0, 9999) g(id)),
 d AS (SELECT id, sum(p.p * ln(p.p / q.p)) AS d FROM w JOIN z za ON za.no = w.a JOIN z zb ON zb.no = w.b JOIN soft p ON p.vec_id = za.vec_id JOIN soft q ON q.vec_id = zb.vec_id AND q.i = p.i GROUP BY 1)
SELECT round(exp(avg(d)), 6) AS score FROM d""")
def modified(t):
    return rounded(ev.modified_inception_score(soft_frame(t), "p", ["vec_id"], 10000, 0))


@query("ev_16c_am_score", f"""WITH {SOFT}, a AS (SELECT i, avg(p) AS p FROM soft WHERE label < 5 GROUP BY 1), g AS (SELECT i, avg(p) AS q FROM soft WHERE label >= 5 GROUP BY 1),
 e AS (SELECT avg(h) AS h FROM (SELECT vec_id, -sum(p * ln(p)) AS h FROM soft WHERE label >= 5 GROUP BY 1)) SELECT round((SELECT sum(p * ln(p / q)) FROM a JOIN g USING (i)) + h, 6) AS score FROM e""")
def am(t):
    p = soft_frame(t)
    return rounded(ev.am_score(p.where("label < 5"), p.where("label >= 5"), "p"))


@query("ev_15_frechet_distance")
def frechet(t):
    e = t.embeddings
    return rounded(ev.frechet_distance(e.where("label < 5"), e.where("label >= 5"), "embedding"))


@query("ev_15_feature_moments", """WITH u AS (SELECT vec_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS side, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
 m AS (SELECT side, i, avg(x) AS m FROM u GROUP BY 1, 2)
SELECT p.side, CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(covar_samp(p.x, q.x), 6) AS value FROM u p JOIN u q ON p.vec_id = q.vec_id GROUP BY 1, 2, 3
UNION ALL SELECT side, CAST(i AS INTEGER), -1, round(m, 6) FROM m""")
def moments(t):
    e = t.embeddings
    return rounded(ev.feature_moments(e.where("label < 5"), e.where("label >= 5"), "embedding").select("side", "i", "j", "value"))


@query("ev_15_frechet_one_feature", """WITH x AS (SELECT label < 5 AS a, list_sum([CAST(v AS DOUBLE) FOR v IN embedding]) AS x FROM embeddings),
 s AS (SELECT avg(x) FILTER (a) AS ma, avg(x) FILTER (NOT a) AS mb, var_samp(x) FILTER (a) AS va, var_samp(x) FILTER (NOT a) AS vb FROM x)
SELECT round(pow(ma - mb, 2) + va + vb - 2 * sqrt(va * vb), 6) AS distance FROM s""")
def frechet_one(t):
    e = t.embeddings.select("label", folds("embedding", 1).alias("x"))
    return rounded(ev.frechet_distance(e.where("label < 5"), e.where("label >= 5"), "x"))


@query("ev_17_ndb")
def ndb(t):
    e = t.embeddings
    return rounded(ev.ndb(e.where("label < 5"), e.where("label >= 5"), "embedding", k=20))


@query("ev_17_two_proportions", f"""WITH {PRED}, n AS (SELECT count(*) FILTER (stationid < '5') AS na, count(*) FILTER (stationid >= '5') AS nb FROM pred), c AS (SELECT actual, count(*) FILTER (stationid < '5') AS ca, count(*) FILTER (stationid >= '5') AS cb FROM pred GROUP BY 1),
 p AS (SELECT actual, ca / na AS p1, cb / nb AS p2, (ca + cb) / (na + nb) AS p, na, nb FROM c, n) SELECT actual, abs(p1 - p2) > 1.96 * sqrt(p * (1 - p) * (1 / na + 1 / nb)) AS differs FROM p""")
def proportions(t):
    low = F.col("stationid") < "5"
    counts = t.pred.groupBy("actual").agg(F.count_if(low).alias("ca"), F.count_if(~low).alias("cb"))
    na, nb = t.pred.agg(F.count_if(low)).scalar(), t.pred.agg(F.count_if(~low)).scalar()
    df = counts.withColumns({"na": na, "nb": nb})
    return df.select("actual", ev.two_proportions(F.col("ca") / F.col("na"), F.col("na"), F.col("cb") / F.col("nb"), F.col("nb")).alias("differs"))


@query("ev_18_tune_thresholds", f"""WITH {SOFT}, o AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_sum([CAST(v AS DOUBLE) FOR v IN embedding]), 9), vec_id) - 1 AS pos, (SELECT count(*) FROM embeddings) AS n,
 CAST(('0x' || substr(md5(concat_ws('|', CAST(vec_id AS VARCHAR), '0')), 1, 1)) AS INTEGER) % 2 AS half FROM embeddings),
 r AS (SELECT lo / 10.0::DOUBLE AS low, hi / 100.0::DOUBLE AS high FROM generate_series(0, 4) a(lo), generate_series(60, 95, 5) b(hi)),
 x AS (SELECT low, high, o.vec_id, half, i, p FROM r JOIN o ON pos >= floor(n * low + 1e-9) AND pos < floor(n * high + 1e-9) JOIN soft s ON s.vec_id = o.vec_id),
 m AS (SELECT low, high, i, avg(p) AS q FROM x WHERE half = 1 GROUP BY 1, 2, 3),
 d AS (SELECT x.low, x.high, x.vec_id, sum(p * ln(p / q)) AS d FROM x JOIN m ON m.low = x.low AND m.high = x.high AND m.i = x.i WHERE half = 0 GROUP BY 1, 2, 3),
 s AS (SELECT low, high, exp(avg(d)) AS score FROM d GROUP BY 1, 2)
SELECT round(low, 2) AS low, round(high, 2) AS high, round(score, 6) AS score, score = max(score) OVER () AS is_best FROM s""")
def tune(t):
    from skyloom.slicing import magnitude_slices

    df = t.embeddings.select("vec_id", F.round(folds("embedding", 1)[0], 9).alias("like")).join(soft_frame(t).drop("label"), "vec_id")
    out = ev.tune_thresholds(df, ["like", "vec_id"], "p", magnitude_slices("like"), ["vec_id"])
    return rounded(out)
