"""Queries on dashboard aggregates, comparisons, orders, pivots and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import dashboard as d
from ..operators import filters, metrics
from ..sources.adapters import results, table
from .registry import query

LAST = "(SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY run_id, question_id ORDER BY ok DESC, ln DESC, pk DESC, sk DESC, q DESC, price DESC) = 1)"


def last_rows(spark, sf, run):
    return d.last_of(results(spark, sf).where(F.col("run_id") == run), "question_id", "pos")


@query("A21_breakdown_filtered", """SELECT "group", count(*) AS count, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy, sum(points_earned) / sum(points) AS weighted_accuracy FROM results WHERE "group" IS NOT NULL AND multimodal GROUP BY "group" """)
def breakdown_filtered(spark, sf):
    return d.breakdown(results(spark, sf).where("multimodal"), "group")


@query("A22_confusion", """
SELECT a.l AS answer, p.l AS predicted, count(r.id) AS count FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) a CROSS JOIN (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) p
LEFT JOIN results r ON r.answer = a.l AND r.predicted = p.l GROUP BY ALL""")
def confusion(spark, sf):
    return d.confusion(results(spark, sf))


@query("A23_predicted_counts", "SELECT upper(predicted) AS predicted, count(*) AS count FROM results WHERE predicted IS NOT NULL GROUP BY ALL")
def predicted_counts(spark, sf):
    return d.predicted_counts(results(spark, sf))


@query("A24_top_warnings", "SELECT warning, count(*) AS count FROM (SELECT unnest(warnings) AS warning FROM results) GROUP BY ALL ORDER BY count DESC, warning LIMIT 10")
def top_warnings(spark, sf):
    return d.top_warnings(results(spark, sf))


@query("A25_histogram", """
WITH e AS (SELECT run_id, greatest(5, least(20, CAST(floor(sqrt(count(*))) AS INTEGER))) AS bins, min(latency_ms) AS lo, max(latency_ms) AS hi FROM results WHERE latency_ms IS NOT NULL GROUP BY run_id),
c AS (SELECT r.run_id, CAST(least(floor((latency_ms - lo) / ((hi - lo) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM results r JOIN e USING (run_id) WHERE latency_ms IS NOT NULL GROUP BY ALL)
SELECT e.run_id, CAST(s.bin AS INTEGER) AS bin, lo + s.bin * ((hi - lo) / bins) AS low, CASE WHEN s.bin = bins - 1 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / bins) END AS high, coalesce(c.n, 0) AS count
FROM e JOIN (SELECT unnest(range(20)) AS bin) s ON s.bin < e.bins LEFT JOIN c ON c.run_id = e.run_id AND c.bin = s.bin""")
def histogram(spark, sf):
    return d.histogram(results(spark, sf), "latency_ms", "run_id")


@query("A26_numeric_summary", "SELECT run_id, count(latency_ms) AS count, avg(latency_ms) AS mean, median(latency_ms) AS median, min(latency_ms) AS min, max(latency_ms) AS max, quantile_cont(latency_ms, 0.25) AS p25, quantile_cont(latency_ms, 0.75) AS p75, round(stddev_pop(latency_ms), 6) AS stddev FROM results GROUP BY run_id")
def numeric_summary(spark, sf):
    return d.summary(results(spark, sf), "latency_ms", "run_id")


SUBSETS = "(SELECT *, unnest(['all', CASE WHEN is_correct THEN 'correct' WHEN NOT is_correct THEN 'incorrect' ELSE 'unknown' END]) AS subset FROM results)"


@query("A20_A27_subset_metrics", f"SELECT subset, count(*) AS count, count(*) / (SELECT count(*) FROM results) AS share, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy, count(*) FILTER (WHERE multimodal) / count(*) AS multimodal_share, avg(points_earned) AS points_mean, median(points_earned) AS points_median, avg(latency_ms) AS latency_mean, median(latency_ms) AS latency_median FROM {SUBSETS} GROUP BY subset")
def subset_metrics(spark, sf):
    return d.subset_metrics(results(spark, sf))


@query("A28_distribution", f"SELECT * FROM (SELECT subset, key, count, count / sum(count) OVER (PARTITION BY subset) AS share, CAST(row_number() OVER (PARTITION BY subset ORDER BY count DESC, key) AS INTEGER) AS place FROM (SELECT subset, coalesce(reasoning_mode, 'Unknown') AS key, count(*) AS count FROM {SUBSETS} GROUP BY ALL)) WHERE place <= 8")
def distribution(spark, sf):
    return d.distribution(results(spark, sf), "reasoning_mode", limit=8)


@query("A28_O02_grade_distribution", f"""
SELECT subset, key, count, count / sum(count) OVER (PARTITION BY subset) AS share, CAST(row_number() OVER (PARTITION BY subset ORDER BY coalesce(try_cast(split_part(key, '-', 1) AS INTEGER), 1000000), coalesce(try_cast(split_part(key, '-', 2) AS INTEGER), 1000000), key) AS INTEGER) AS place
FROM (SELECT subset, coalesce("group", 'Unknown') AS key, count(*) AS count FROM {SUBSETS} GROUP BY ALL)""")
def grade_distribution(spark, sf):
    return d.distribution(results(spark, sf), "group", by_range=True)


@query("A29_facets", """
SELECT attribute, list_sort(list(DISTINCT value)) AS values FROM (
  SELECT 'year' AS attribute, CAST(year AS VARCHAR) AS value FROM results UNION ALL SELECT 'group', "group" FROM results UNION ALL SELECT 'language', language FROM results
  UNION ALL SELECT 'reasoning_mode', reasoning_mode FROM results UNION ALL SELECT 'predicted', predicted FROM results UNION ALL SELECT 'warnings', unnest(warnings) FROM results) WHERE value IS NOT NULL GROUP BY attribute""")
def facets(spark, sf):
    return d.facets(results(spark, sf))


RUNS = """(SELECT run_id, 'model-' || lower(run_id) AS model, CASE WHEN run_id LIKE 'A%' THEN 'fast' ELSE 'full' END AS mode, count(error) AS failed, count(*) AS rows,
  TIMESTAMP '2024-05-01 12:00:00' + INTERVAL 1 DAY * (ascii(substr(run_id, 1, 1)) - 65) AS ts, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM results GROUP BY run_id)"""


def runs(spark, sf):
    out = results(spark, sf).groupBy("run_id").agg(F.count("error").alias("failed"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_correct"), 1)).alias("correct"))
    day = F.ascii(F.substring("run_id", 1, 1)) - 65
    name = F.concat(F.date_format(F.date_add(F.lit("2024-05-01"), day), "yyyyMMdd"), F.lit("_120000_model-"), F.lower("run_id"))
    return out.withColumn("run_name", name).select("run_id", "run_name", scoring.model_label("run_name").alias("model"), F.lit("lineitem").alias("dataset"), F.when(F.col("run_id").startswith("A"), "fast").otherwise("full").alias("mode"), "failed", "rows", scoring.run_time("run_name").alias("ts"), (F.col("correct") / F.col("rows")).alias("accuracy"))


@query("P08_O03_run_overview", f"SELECT run_id, model, mode, failed, accuracy, ts FROM {RUNS} WHERE model LIKE '%-n%' AND failed > 0 AND ts >= TIMESTAMP '2024-05-02' AND ts < TIMESTAMP '2024-05-15' ORDER BY accuracy DESC")
def run_overview(spark, sf):
    wanted = filters.run_condition("MODEL-N", has_failures=True, date_from="2024-05-02", date_to="2024-05-14")
    return runs(spark, sf).where(wanted).orderBy(F.desc_nulls_last("accuracy"), "run_id").select("run_id", "model", "mode", "failed", "accuracy", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("A30_overview_facets", f"SELECT attribute, value, count(*) AS total, count(*) FILTER (WHERE active) AS active FROM (SELECT mode = 'full' AS active, unnest([{{'attribute': 'model', 'value': model}}, {{'attribute': 'mode', 'value': mode}}], recursive := true) FROM {RUNS}) GROUP BY ALL")
def overview_facets(spark, sf):
    return d.overview_facets(runs(spark, sf), filters.run_condition(modes=["full"]), ["model", "mode"])


@query("J01_A32_run_pair", f"SELECT a.question_id, a.points_earned AS a_points_earned, b.points_earned AS b_points_earned, b.points_earned - a.points_earned AS points_delta, b.latency_ms - a.latency_ms AS latency_delta, b.total_tokens - a.total_tokens AS tokens_delta FROM {LAST} a JOIN {LAST} b USING (question_id) WHERE a.run_id = 'AF' AND b.run_id = 'NO'")
def run_pair(spark, sf):
    both = d.run_pair(last_rows(spark, sf, "AF"), last_rows(spark, sf, "NO"), "question_id", ["points_earned", "latency_ms", "total_tokens"])
    delta = lambda c: F.col(f"b_{c}") - F.col(f"a_{c}")
    return both.select("question_id", "a_points_earned", "b_points_earned", delta("points_earned").alias("points_delta"), delta("latency_ms").alias("latency_delta"), delta("total_tokens").alias("tokens_delta"))


@query("P13_changed_views", f"""
SELECT view, question_id FROM (SELECT a.question_id, a.is_correct AS ac, b.is_correct AS bc, a.predicted AS ap, b.predicted AS bp FROM {LAST} a JOIN {LAST} b USING (question_id) WHERE a.run_id = 'AF' AND b.run_id = 'RF'),
(SELECT unnest(['changed', 'improved', 'regressed']) AS view)
WHERE CASE view WHEN 'changed' THEN ac IS DISTINCT FROM bc OR ap IS DISTINCT FROM bp WHEN 'improved' THEN NOT coalesce(ac, false) AND coalesce(bc, false) ELSE coalesce(ac, false) AND NOT coalesce(bc, false) END""")
def changed_views(spark, sf):
    both = d.run_pair(last_rows(spark, sf, "AF"), last_rows(spark, sf, "RF"), "question_id", ["is_correct", "predicted"])
    view = F.explode(F.filter(F.array(*[F.when(filters.changed(v), F.lit(v)) for v in ("changed", "improved", "regressed")]), lambda v: v.isNotNull()))
    return both.select(view.alias("view"), "question_id")


@query("J02_pair_breakdown", """
WITH b AS (SELECT run_id, "group" AS k, count(*) AS count, count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM results WHERE "group" IS NOT NULL AND (run_id <> 'AF' OR year < 1998) GROUP BY ALL)
SELECT coalesce(x.k, y.k) AS "group", x.accuracy AS a_accuracy, x.count AS a_count, y.accuracy AS b_accuracy, y.count AS b_count, y.accuracy - x.accuracy AS delta FROM (SELECT * FROM b WHERE run_id = 'AF') x FULL JOIN (SELECT * FROM b WHERE run_id = 'RF') y ON x.k = y.k""")
def pair_breakdown(spark, sf):
    rows = results(spark, sf)
    return d.pair_breakdown(d.breakdown(rows.where("run_id = 'AF' and year < 1998"), "group"), d.breakdown(rows.where("run_id = 'RF'"), "group"), "group")


@query("A31_metric_deltas", f"""
WITH m AS (SELECT run_id, unnest([{{'metric': 'accuracy', 'value': count(*) FILTER (WHERE predicted IS NOT NULL AND error IS NULL AND is_correct) / count(*) FILTER (WHERE predicted IS NOT NULL AND error IS NULL)}}, {{'metric': 'answered', 'value': count(*) FILTER (WHERE predicted IS NOT NULL AND error IS NULL) * 1.0::DOUBLE}},
  {{'metric': 'failed', 'value': count(error) * 1.0::DOUBLE}}, {{'metric': 'latency', 'value': avg(latency_ms) FILTER (WHERE predicted IS NOT NULL AND error IS NULL)}}], recursive := true) FROM results GROUP BY run_id)
SELECT metric, a.value AS a, b.value AS b, b.value - a.value AS delta FROM (SELECT * FROM m WHERE run_id = 'AF') a JOIN (SELECT * FROM m WHERE run_id = 'NO') b USING (metric)""")
def metric_deltas(spark, sf):
    rows = results(spark, sf)
    wide = metrics.status_counts(rows, "run_id").join(metrics.latency(rows, "run_id"), "run_id")
    long = wide.select("run_id", F.expr("stack(4, 'accuracy', accuracy, 'answered', cast(answered as double), 'failed', cast(failed as double), 'latency', mean_latency) as (metric, value)"))
    side = lambda run, name: long.where(F.col("run_id") == run).select("metric", F.col("value").alias(name))
    return side("AF", "a").join(side("NO", "b"), "metric").withColumn("delta", F.col("b") - F.col("a"))


@query("A33_difficulty", "SELECT question_id, avg(CAST(is_correct AS INTEGER)) AS p_correct, stddev_pop(CAST(is_correct AS INTEGER)) AS disagreement, count(*) AS n FROM results WHERE is_correct IS NOT NULL GROUP BY question_id")
def difficulty(spark, sf):
    return d.difficulty(results(spark, sf))


QUESTIONS = "(SELECT (p_partkey % 200) || '-' || (1 + p_partkey % 7) AS question_id, min(1995 + p_partkey % 6) AS year, CASE WHEN min(p_partkey) % 3 > 0 THEN (min(p_partkey) % 64) / 64.0::DOUBLE END AS human_p FROM part GROUP BY 1)"


def questions(spark, sf):
    key = F.concat_ws("-", F.col("p_partkey") % 200, 1 + F.col("p_partkey") % 7)
    return table(spark, sf, "part").groupBy(key.alias("question_id")).agg(F.min(1995 + F.col("p_partkey") % 6).alias("year"), F.min("p_partkey").alias("k")).select("question_id", "year", F.when(F.col("k") % 3 > 0, (F.col("k") % 64) / F.lit(64.0)).alias("human_p"), F.array(F.concat(F.lit("t"), F.col("k") % 4), F.concat(F.lit("u"), F.col("k") % 3)).alias("tags"))


@query("A34_A36_J03_S10_yearly", f"""
WITH x AS (SELECT question_id, avg(CAST(is_correct AS INTEGER)) AS p_correct FROM results WHERE is_correct IS NOT NULL GROUP BY question_id)
SELECT year, avg(human_p) AS human, avg(round(p_correct * 1048576) / 1048576) AS llm, count(*) AS questions, avg(human_p) / avg(round(p_correct * 1048576) / 1048576) AS ratio FROM x JOIN {QUESTIONS} USING (question_id) WHERE human_p IS NOT NULL GROUP BY year""")
def yearly(spark, sf):
    q = questions(spark, sf)
    exact = d.difficulty(results(spark, sf)).withColumn("p_correct", F.round(F.col("p_correct") * 1048576) / 1048576)
    return d.yearly(exact, q.select("question_id", "year"), q.where("human_p is not null").select("question_id", "human_p"))


@query("A35_tag_means", """
WITH x AS (SELECT question_id, round(avg(CAST(is_correct AS INTEGER)) * 1048576) / 1048576 AS p_correct FROM results WHERE is_correct IS NOT NULL GROUP BY question_id),
t AS (SELECT (p_partkey % 200) || '-' || (1 + p_partkey % 7) AS question_id, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT tag, avg(p_correct) AS mean, count(*) AS count FROM (SELECT p_correct, unnest(['t' || (k % 4), 'u' || (k % 3)]) AS tag FROM x JOIN t USING (question_id)) GROUP BY tag""")
def tag_means(spark, sf):
    exact = d.difficulty(results(spark, sf)).withColumn("p_correct", F.round(F.col("p_correct") * 1048576) / 1048576)
    return d.tag_means(exact, questions(spark, sf))


@query("O01_P17_page", "SELECT id, latency_ms FROM results ORDER BY coalesce(latency_ms, 0) DESC, id LIMIT 25 OFFSET 50")
def page(spark, sf):
    return d.page(results(spark, sf).select("id", "latency_ms"), "latency_ms", True, 50, 25)


EXAM = '(SELECT run_id, year, "group", sum(points_earned) AS total, sum(points) AS possible, sum(points_earned) / sum(points) AS pct FROM results WHERE "group" IS NOT NULL GROUP BY ALL)'


def exam_scores(spark, sf):
    out = results(spark, sf).where(F.col("group").isNotNull()).groupBy("run_id", "year", "group").agg(F.sum("points_earned").alias("total"), F.sum("points").alias("possible"))
    return out.withColumn("pct", F.col("total") / F.col("possible"))


@query("O05_exam_winner", f'SELECT year, "group", run_id, pct FROM {EXAM} QUALIFY row_number() OVER (PARTITION BY year, "group" ORDER BY pct DESC, run_id) = 1')
def exam_winner(spark, sf):
    return d.top_by(exam_scores(spark, sf), ["year", "group"], F.desc("pct"), F.col("run_id")).select("year", "group", "run_id", "pct")


@query("O06_E16_winner_margin", f'SELECT year, "group", run_id AS winner, pct AS best, runner_up, pct - second AS margin FROM (SELECT *, row_number() OVER w AS place, lead(run_id) OVER w AS runner_up, lead(pct) OVER w AS second FROM {EXAM} WINDOW w AS (PARTITION BY year, "group" ORDER BY pct DESC, run_id)) WHERE place = 1')
def winner_margin(spark, sf):
    return d.winners(exam_scores(spark, sf), ["year", "group"], "pct", "run_id")


@query("O07_modality_winner", "SELECT multimodal, run_id AS winner, acc AS best, runner_up, acc - second AS margin FROM (SELECT *, row_number() OVER w AS place, lead(run_id) OVER w AS runner_up, lead(acc) OVER w AS second FROM (SELECT multimodal, run_id, count(*) FILTER (WHERE is_correct) / count(*) AS acc FROM results GROUP BY ALL) WINDOW w AS (PARTITION BY multimodal ORDER BY acc DESC, run_id)) WHERE place = 1")
def modality_winner(spark, sf):
    acc = results(spark, sf).groupBy("multimodal", "run_id").agg((F.count(F.when(F.col("is_correct"), 1)) / F.count(F.lit(1))).alias("acc"))
    return d.winners(acc, ["multimodal"], "acc", "run_id")


@query("O04_O08_O10_top_bottom", f"""(SELECT 'top' AS side, run_id, year, "group", pct FROM {EXAM} ORDER BY pct DESC, run_id, year, "group" LIMIT 5) UNION ALL (SELECT 'bottom', run_id, year, "group", pct FROM {EXAM} ORDER BY pct, run_id, year, "group" LIMIT 5)""".replace("(SELECT 'top'", "SELECT * FROM (SELECT 'top'", 1))
def top_bottom(spark, sf):
    x, cols = exam_scores(spark, sf), ["run_id", "year", "group", "pct"]
    ends = [("top", F.desc("pct")), ("bottom", F.asc("pct"))]
    top, bottom = (x.orderBy(o, "run_id", "year", "group").limit(5).select(F.lit(side).alias("side"), *cols) for side, o in ends)
    return top.unionByName(bottom)


@query("O09_best_years", f"SELECT year, round(avg(pct), 9) AS mean_pct FROM {EXAM} GROUP BY year ORDER BY mean_pct DESC, year LIMIT 3")
def best_years(spark, sf):
    return exam_scores(spark, sf).groupBy("year").agg(F.round(F.avg("pct"), 9).alias("mean_pct")).orderBy(F.desc("mean_pct"), "year").limit(3)


@query("O11_argmax_run", "SELECT arg_max(run_id, acc) AS run_id, max(acc) AS accuracy FROM (SELECT run_id, count(*) FILTER (WHERE is_correct) / count(*) AS acc FROM results GROUP BY run_id)")
def argmax_run(spark, sf):
    acc = results(spark, sf).groupBy("run_id").agg((F.count(F.when(F.col("is_correct"), 1)) / F.count(F.lit(1))).alias("acc"))
    return acc.agg(F.max_by("run_id", "acc").alias("run_id"), F.max("acc").alias("accuracy"))


NULL_LAST = 'SELECT run_id, year, "group", CAST(row_number() OVER (PARTITION BY run_id ORDER BY p NULLS LAST, year, "group") AS INTEGER) AS place FROM (SELECT run_id, year, "group", CASE WHEN year % 2 = 0 THEN pct END AS p FROM ' + EXAM + ")"


@query("O12_null_last_sort", NULL_LAST)
@query("O12_null_last_sort_whole", NULL_LAST)
def null_last_places(spark, sf):
    """Every row of each run; the second name is that of an earlier round, when the first had a limit."""
    x = exam_scores(spark, sf).withColumn("p", F.when(F.col("year") % 2 == 0, F.col("pct")))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.asc_nulls_last("p"), "year", "group"))
    return x.withColumn("place", place).select("run_id", "year", "group", "place")


@query("O13_grade_sort_key", """SELECT DISTINCT "group", coalesce(try_cast(split_part("group", '-', 1) AS INTEGER), -1) AS least, coalesce(try_cast(split_part("group", '-', 2) AS INTEGER), -1) AS most FROM results WHERE "group" IS NOT NULL""")
def grade_sort_key(spark, sf):
    n = scoring.grade_numbers("group")
    return results(spark, sf).where(F.col("group").isNotNull()).select("group").distinct().select("group", F.coalesce(F.array_min(n), F.lit(-1)).alias("least"), F.coalesce(F.array_max(n), F.lit(-1)).alias("most"))


@query("U01_U02_union_distinct", """SELECT DISTINCT year, "group" FROM results WHERE run_id IN ('AF', 'RF') AND "group" IS NOT NULL""")
def union_distinct(spark, sf):
    rows = results(spark, sf).where(F.col("group").isNotNull()).select("run_id", "year", "group")
    return rows.where("run_id = 'AF'").unionByName(rows.where("run_id = 'RF'")).select("year", "group").distinct()


@query("U03_J09_key_sets", """
WITH a AS (SELECT DISTINCT question_id FROM results WHERE run_id = 'AF'), b AS (SELECT DISTINCT question_id FROM results WHERE run_id = 'NF')
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_sets(spark, sf):
    a, b = (results(spark, sf).where(F.col("run_id") == r).select("question_id").distinct() for r in ("AF", "NF"))
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "only_a")).unionByName(n(b.join(a, "question_id", "left_anti"), "only_b"))


@query("U04_pivot_recall", """SELECT "group", count(*) FILTER (WHERE is_correct AND run_id = 'AF') / count(*) FILTER (WHERE run_id = 'AF') AS "AF", count(*) FILTER (WHERE is_correct AND run_id = 'NO') / count(*) FILTER (WHERE run_id = 'NO') AS "NO" FROM results WHERE "group" IS NOT NULL GROUP BY "group" """)
def pivot_recall(spark, sf):
    hit = F.avg(F.coalesce("is_correct", F.lit(False)).cast("int"))
    return results(spark, sf).where(F.col("group").isNotNull()).groupBy("group").pivot("run_id", ["AF", "NO"]).agg(hit)


@query("U05_leave_one_out", f'SELECT run_id, year, "group", sum(total) OVER w / count(*) OVER w AS ensemble, CASE WHEN count(*) OVER w > 1 THEN (sum(total) OVER w - total) / (count(*) OVER w - 1) END AS others FROM {EXAM} WINDOW w AS (PARTITION BY year, "group")')
def leave_one_out(spark, sf):
    return d.leave_one_out(exam_scores(spark, sf), ["year", "group"], "total").select("run_id", "year", "group", "ensemble", "others")


@query("U06_crosstab", """SELECT year, count(*) FILTER (WHERE language = 'de') AS de, count(*) FILTER (WHERE language = 'en') AS en FROM results GROUP BY year""")
def crosstab(spark, sf):
    return results(spark, sf).groupBy("year").pivot("language", ["de", "en"]).count().na.fill(0)


@query("W01_z_scores", f'SELECT run_id, year, "group", round(CASE WHEN stddev_pop(total) OVER w > 0 THEN (total - avg(total) OVER w) / stddev_pop(total) OVER w ELSE 0 END, 6) AS z FROM {EXAM} WINDOW w AS (PARTITION BY year, "group")')
def z_scores(spark, sf):
    return d.z_scores(exam_scores(spark, sf), ["year", "group"], "total").select("run_id", "year", "group", F.round("z", 6).alias("z"))


@query("W03_ema", f"""
WITH x AS (SELECT run_id, pct, row_number() OVER (PARTITION BY run_id ORDER BY year DESC, "group" DESC) - 1 AS age, row_number() OVER (PARTITION BY run_id ORDER BY year, "group") = 1 AS first FROM {EXAM})
SELECT run_id, round(sum(pct * 0.8 ** age * CASE WHEN first THEN 1 ELSE 0.2 END), 9) AS ema, CAST(count(*) AS INTEGER) AS n FROM x GROUP BY run_id""")
def ema(spark, sf):
    return d.ema(exam_scores(spark, sf), ["run_id"], ["year", "group"], "pct").withColumn("ema", F.round("ema", 9))


@query("W04_quantile_bins", f"""
WITH x AS {EXAM}, c AS (SELECT list_distinct([quantile_cont(pct, i) FOR i IN [0.0]]) AS none, list_sort(list_distinct([quantile_cont(pct, 0.0), quantile_cont(pct, 1/6.0::DOUBLE), quantile_cont(pct, 2/6.0::DOUBLE), quantile_cont(pct, 0.5), quantile_cont(pct, 4/6.0::DOUBLE), quantile_cont(pct, 5/6.0::DOUBLE), quantile_cont(pct, 1.0)])) AS cuts FROM x)
SELECT CAST(greatest(1, len(list_filter(cuts, lambda v: v < pct))) - 1 AS INTEGER) AS bin, count(*) AS n, round(avg(pct), 9) AS mean FROM x, c GROUP BY 1""".replace("list_distinct([quantile_cont(pct, i) FOR i IN [0.0]]) AS none, ", ""))
def quantile_bins(spark, sf):
    return d.quantile_bins(exam_scores(spark, sf), "pct", 6).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pct"), 9).alias("mean"))


@query("J19_run_index", "SELECT question_id, list_sort(list(DISTINCT run_id)) AS runs FROM results GROUP BY question_id")
def run_index(spark, sf):
    return results(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_set("run_id")).alias("runs"))


@query("J20_first_run_max", f'SELECT year, "group", arg_min(possible, run_id) AS max_score FROM {EXAM} GROUP BY ALL')
def first_run_max(spark, sf):
    return exam_scores(spark, sf).groupBy("year", "group").agg(F.min_by("possible", "run_id").alias("max_score"))


@query("S11_point_lookup", "SELECT id, answer, points FROM results WHERE ok = 4099")
def point_lookup(spark, sf):
    return results(spark, sf).where("pos.ok = 4099").select("id", "answer", "points")
