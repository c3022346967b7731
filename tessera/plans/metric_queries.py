"""Evaluation analytics: rates, percentiles, transitions, paired comparisons, intervals of resampled clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import wilson
from tessera.operators import metrics, resample, screening
from tessera.plans.base import Tables, query

SIX = lambda c: F.round(c, 6)


@query("""SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars > 2000) AS long_docs
FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())""")
def stats_grouping_sets(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    out = d.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum((F.col("n_chars") > 2000).cast("long")).alias("long_docs"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("all"))).withColumn("source", F.coalesce("source", F.lit("all")))


@query("""WITH j AS (SELECT d.*, quality, toxic FROM documents d JOIN labels USING (doc_id))
SELECT CASE WHEN quality = 1 THEN 'benign' ELSE 'attack' END AS kind, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS language, count(*) AS n,
 round(avg((toxic = 1)::INT), 6) AS toxic_rate, round(sum(CASE WHEN toxic = 0 THEN n_chars ELSE 0 END) / count(*), 6) AS effective_chars, round(avg(n_chars) FILTER (WHERE toxic = 0), 6) AS conditional_chars
FROM j GROUP BY GROUPING SETS ((CASE WHEN quality = 1 THEN 'benign' ELSE 'attack' END, lang), (CASE WHEN quality = 1 THEN 'benign' ELSE 'attack' END))""")
def cohort_rates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.documents.join(t.labels, "doc_id").select("n_chars", "toxic", F.when(F.col("quality") == 1, "benign").otherwise("attack").alias("kind"), F.col("lang").alias("language"))
    useful = F.col("toxic") == 0
    return metrics.cohorts(j, "kind", "language", [F.count("*").alias("n"), SIX(metrics.rate(F.col("toxic") == 1)).alias("toxic_rate"), SIX(metrics.effective_mean(F.col("n_chars"), useful)).alias("effective_chars"), SIX(metrics.conditional_mean(F.col("n_chars"), useful)).alias("conditional_chars")])


OUTCOME_SQL = """o AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'abstention' WHEN event_type = 'error' THEN 'execution_error' WHEN event_type = 'signup' OR event_id % 9 = 0 THEN 'abstention' ELSE 'answer' END AS outcome FROM events)"""


def _outcomes(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    failed = F.col("event_type") == "error"
    status = F.when(failed, "exception").otherwise("response")
    exception = F.when(failed & (F.col("event_id") % 2 == 0), "GeneratedAnswerRejected").when(failed, "Timeout")
    mode = F.when(F.col("event_type") == "signup", "unavailable").otherwise("normal")
    answer = F.when(F.col("event_id") % 9 == 0, " The provided evidence is  insufficient to answer this question. ").otherwise("Sing it softly.")
    return e.select("event_id", "user_id", "ts", screening.outcome(status, exception, mode, answer).alias("outcome"))


@query(f"WITH {OUTCOME_SQL} SELECT outcome, count(*) AS n, count(DISTINCT user_id) AS users FROM o GROUP BY outcome")
def outcome_counts(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH {OUTCOME_SQL}, h AS (SELECT user_id, date_trunc('hour', ts) AS h, string_agg(outcome, ' -> ' ORDER BY event_id) AS path FROM o GROUP BY ALL) SELECT path, count(*) AS cases FROM h GROUP BY path""")
def outcome_transitions(spark, sf_dir):
    o = _outcomes(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    return metrics.transitions(o, ["user_id", "h"], "event_id", "outcome")


@query(f"""WITH {OUTCOME_SQL}, c AS (SELECT user_id, count(*) AS n, count(DISTINCT outcome) AS k, count(DISTINCT outcome || '|' || (event_id % 2)::VARCHAR) AS a FROM o GROUP BY user_id)
SELECT count(*) FILTER (WHERE n > 1) AS cases, count(*) FILTER (WHERE n > 1 AND k = 1) AS identical_outcomes, count(*) FILTER (WHERE n > 1 AND a = 1) AS identical_answers_and_outcomes, count(*) FILTER (WHERE n = 1) AS unpaired_cases FROM c""")
def repeat_agreement(spark, sf_dir):
    return metrics.agreement(_outcomes(spark, sf_dir), ["user_id"], F.col("outcome"), F.col("event_id") % 2)


@query(f"""WITH {OUTCOME_SQL}, f AS (SELECT user_id, arg_min(outcome, event_id) AS before, arg_max(outcome, event_id) AS after FROM o GROUP BY user_id) SELECT before, after, count(*) AS n FROM f GROUP BY ALL""")
def verdict_transition_matrix(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    first = o.groupBy("user_id").agg(F.min_by("outcome", "event_id").alias("outcome"))
    last = o.groupBy("user_id").agg(F.max_by("outcome", "event_id").alias("outcome"))
    return metrics.contingency(first, last, ["user_id"], "outcome")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile_linear(spark, sf_dir):
    out = metrics.percentiles(Tables(spark, sf_dir).events.select("event_type", "value"), ["event_type"], "value", {"p50": (metrics.LINEAR, 0.5), "p95": (metrics.LINEAR, 0.95)})
    return out.withColumns({"p50": SIX("p50"), "p95": SIX("p95")})


@query("SELECT user_id, round(list_sort(list(value))[(floor((count(value) - 1) * 0.9) + 1)::BIGINT], 6) AS p90 FROM events WHERE value IS NOT NULL GROUP BY user_id")
def percentile_lower_index(spark, sf_dir):
    return metrics.lower_index(Tables(spark, sf_dir).events, ["user_id"], "value", {"p90": 0.9}).withColumn("p90", SIX("p90"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_disc(value, 0.95), 6) AS p95_value, round(max(value), 6) AS max_value FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf_dir):
    out = Tables(spark, sf_dir).events.groupBy("event_type").agg(*metrics.latency("value"))
    return out.select("event_type", "n", *(SIX(c).alias(c) for c in ("mean_value", "median_value", "p95_value", "max_value")))


@query("""WITH c AS (SELECT event_type, user_id, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, count(*) AS cases, sum(n)::BIGINT AS requests, round(avg(v), 6) AS mean_value, round(quantile_cont(v, 0.5), 6) AS median_value, round(quantile_cont(v, 0.95), 6) AS p95_value FROM c GROUP BY event_type""")
def two_level_latency(spark, sf_dir):
    out = metrics.two_level(Tables(spark, sf_dir).events, ["event_type"], "user_id", "value")
    return out.select("event_type", "cases", "requests", *(SIX(c).alias(c) for c in ("mean_value", "median_value", "p95_value")))


PAIR_SQL = """l AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), r AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
p AS (SELECT l.v AS a, r.v AS b, round(r.v, 1) - round(l.v, 1) AS d FROM l FULL JOIN r ON l.user_id = r.user_id)"""


def _pairs(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    side = lambda t: metrics.ordered_mean(e.filter(F.col("event_type") == t), ["user_id"], "value", "event_id", "v").withColumn("v", metrics.rounded(F.col("v"), 1))
    return metrics.paired(side("click"), side("view"), ["user_id"], "v")


#: The same with sums added up in the order of events, so that no mean hangs on threads or on the order of rows in files.
ORDERED_PAIR_SQL = PAIR_SQL.replace("avg(value)", "sum(value ORDER BY event_id, value) / count(value)")


@query(f"WITH {ORDERED_PAIR_SQL} SELECT count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right FROM p")
def paired_win_tie_loss(spark, sf_dir):
    return metrics.win_tie_loss(_pairs(spark, sf_dir)).drop("median_difference")


@query(f"WITH {PAIR_SQL} SELECT count(d) AS pairs, round(median(d), 6) AS median_difference, round(avg(d), 6) AS mean_difference FROM p")
def paired_median_diff(spark, sf_dir):
    d = F.col("difference")
    return _pairs(spark, sf_dir).agg(F.count(d).alias("pairs"), SIX(metrics.percentile_linear(d, 0.5)).alias("median_difference"), SIX(F.avg(d)).alias("mean_difference"))


@query("""WITH c AS (SELECT lang, sum(toxic)::DOUBLE AS s, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang),
w AS (SELECT lang, s, n, s / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
SELECT lang, s::BIGINT AS toxic, n::BIGINT AS n, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low,
 round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM w""")
def wilson_interval(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    low, high = wilson(F.col("toxic"), F.col("n"))
    return c.withColumn("low", SIX(low)).withColumn("high", SIX(high))


def _clusters(spark, sf_dir, group):
    e = Tables(spark, sf_dir).events.filter("value IS NOT NULL").withColumn("cluster", F.col("user_id") % 40)
    return resample.clusters(e, group, "cluster", F.col("value"))


@query("""WITH c AS (SELECT user_id % 40 AS cluster, sum(value) AS total, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS place, count(*) OVER () AS k FROM c),
s AS (SELECT d.draw, s.slot, ('0x' || substr(md5('7:' || d.draw::VARCHAR || ':' || s.slot::VARCHAR), 1, 15))::BIGINT % (SELECT count(*) FROM c) AS place
      FROM (SELECT unnest(range(400)) AS draw) d, (SELECT unnest(range((SELECT count(*) FROM c))) AS slot) s),
e AS (SELECT draw, sum(total) / sum(n) AS e FROM s JOIN p USING (place) GROUP BY draw)
SELECT round((SELECT sum(total) / sum(n) FROM c), 6) AS estimate, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high, (SELECT count(*) FROM c) AS clusters, count(*) AS draws FROM e""")
def cluster_bootstrap_hash(spark, sf_dir):
    out = resample.hash_bootstrap(_clusters(spark, sf_dir, []), 400, 7)
    return out.select(SIX("estimate").alias("estimate"), SIX("low").alias("low"), SIX("high").alias("high"), "clusters", "draws")


@query()
def cluster_bootstrap_mt(spark, sf_dir):
    per = _clusters(spark, sf_dir, ["event_type"])
    equal = resample.python_equal_clusters(per, ["event_type"], 1000).withColumn("method", F.lit("equal_clusters"))
    ratio = resample.python_weighted_ratio(per, ["event_type"], 1000).withColumn("method", F.lit("weighted_ratio"))
    return equal.unionByName(ratio)


@query("""WITH j AS (SELECT lang, toxic, quality, n_chars % 5 AS d FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS requests, count(*) FILTER (WHERE quality = 1) AS useful, round(sum(CASE WHEN quality = 1 THEN d ELSE 0 END) / count(*), 6) AS effective_mean,
 round(avg(d) FILTER (WHERE quality = 1), 6) AS conditional_mean, round(avg(toxic) FILTER (WHERE quality = 1), 6) AS attack_rate_assessed FROM j GROUP BY ROLLUP (lang)""")
def effective_and_conditional_means(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.documents.join(t.labels, "doc_id").select("lang", "toxic", "quality", (F.col("n_chars") % 5).alias("d"))
    useful = F.col("quality") == 1
    return metrics.rolled_up(
        j, "lang",
        [F.count("*").alias("requests"), F.sum(useful.cast("long")).alias("useful"), SIX(metrics.effective_mean(F.col("d"), useful)).alias("effective_mean"), SIX(metrics.conditional_mean(F.col("d"), useful)).alias("conditional_mean"), SIX(metrics.rate(F.col("toxic") == 1, useful)).alias("attack_rate_assessed")],
    )


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS best_doc, max(n_chars) AS n_chars, round((max(n_chars) / 40000.0 - 0.05) / (1 - 0.05), 6) AS rescaled FROM documents GROUP BY source")
def best_configuration(spark, sf_dir):
    from tessera.functions.vectors import rescaled

    d = Tables(spark, sf_dir).documents
    out = d.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best_doc"), F.max("n_chars").alias("n_chars"))
    return out.withColumn("rescaled", SIX(rescaled(F.col("n_chars") / 40000.0, F.lit(0.05))))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, count(*) AS calls, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag AS stage, calls // 10 AS bucket, count(*) AS n, round(min(m), 2) AS lowest, round(max(m), 2) AS highest, round(median(m), 2) AS median_value FROM s GROUP BY ALL""")
def stage_profile(spark, sf_dir):
    s = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", F.col("l_returnflag").alias("stage")).agg(F.count("*").alias("calls"), F.avg("l_extendedprice").alias("m"))
    return s.groupBy("stage", F.floor(F.col("calls") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.min("m"), 2).alias("lowest"), F.round(F.max("m"), 2).alias("highest"), F.round(metrics.percentile_linear(F.col("m"), 0.5), 2).alias("median_value"))


@query("""WITH d AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT user_id, n FROM d WHERE event_type = 'click'), w AS (SELECT user_id, n FROM d WHERE event_type = 'view')
SELECT CASE WHEN o.n > 12 AND coalesce(w.n, 0) <= 12 THEN 'resolved' ELSE 'new' END AS change, user_id FROM o FULL JOIN w USING (user_id) WHERE (coalesce(o.n, 0) > 12) <> (coalesce(w.n, 0) > 12)""")
def regression_lists(spark, sf_dir):
    d = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = metrics.paired(d.filter("event_type = 'click'"), d.filter("event_type = 'view'"), ["user_id"], "n")
    before, after = F.coalesce("left_value", F.lit(0)) > 12, F.coalesce("right_value", F.lit(0)) > 12
    return pairs.filter(before != after).select(F.when(before, "resolved").otherwise("new").alias("change"), "user_id")


@query("""WITH r AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
j AS (SELECT DISTINCT user_id FROM events), c AS (SELECT count(*) AS jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status IS NULL) AS pending FROM j LEFT JOIN r USING (user_id))
SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM c""")
def run_status(spark, sf_dir):
    from tessera.operators.selection import keep_first
    from tessera.streaming import jobs

    e = Tables(spark, sf_dir).events
    first = keep_first(e.filter("event_id % 3 = 0"), ["user_id"], [F.col("event_id")])
    results = first.select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"))
    return jobs.run_status(e.select("user_id"), results, ["user_id"], "status")
