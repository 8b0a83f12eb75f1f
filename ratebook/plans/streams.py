"""Streaming queries, drained over the given tables."""

from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions.columns import rounded
from ratebook.plans.features import SCORE_SQL
from ratebook.plans.registry import query
from ratebook.plans.sql import ACT, with_ctes
from ratebook.plans.validation import CHECKED, _age, _bmi, _kids
from ratebook.sources import portfolio
from ratebook.session import work_path
from ratebook.streaming import latest, monitors, scoring

_TYPES = ("click", "error", "purchase", "signup", "view")


@query("l10_stream_drift", with_ctes(f"""
, b AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events), bs AS (SELECT event_type, count(*)*1.0/(SELECT count(*) FROM events) AS share FROM events GROUP BY event_type),
w AS (SELECT date_trunc('day', ts) AS window_start, count(value) AS n, avg(value) AS new_mean, count(*) AS r FROM events GROUP BY 1),
c AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS k FROM events GROUP BY 1, 2),
g AS (SELECT w.window_start, sum(abs(coalesce(k,0)/r-share))*0.5 AS tvd FROM w JOIN bs ON true LEFT JOIN c ON c.window_start=w.window_start AND c.event_type=bs.event_type GROUP BY 1)
SELECT strftime(w.window_start,'%Y-%m-%d') AS day, n, round(new_mean,6) AS new_mean, round(abs(new_mean-mu)/(sd/sqrt(n)+1e-10),6) AS z, round(tvd,6) AS tvd,
 abs(new_mean-mu)/(sd/sqrt(n)+1e-10)>2.0 AS mean_drifted, tvd>0.05 AS mix_drifted FROM w JOIN g ON g.window_start=w.window_start, b"""))
def stream_drift(spark, d):
    baseline = monitors.event_baseline(portfolio.table(spark, d, "events"))
    counts = monitors.drained(monitors.windowed_counts(monitors.stream_table(spark, d, "events")), "drift", "window_start", "event_type")
    out = monitors.drift_figures(counts, baseline)
    return rounded(out.withColumn("day", monitors.utc_day("window_start")).drop("window_start"), 6)


@query("l11_stream_requests", with_ctes("""
SELECT strftime(date_trunc('day', ts),'%Y-%m-%d') AS day, count(*) FILTER (NOT rejected) AS total, count(*) FILTER (NOT ok AND NOT rejected) AS errors, count(*) FILTER (rejected) AS rejected,
 round(count(*) FILTER (NOT ok AND NOT rejected)*100.0/count(*) FILTER (NOT rejected),6) AS error_pct, round(avg(latency) FILTER (NOT rejected),6) AS mean FROM requests GROUP BY 1"""))
def stream_requests(spark, d):
    """Without the approximate percentiles, which have no exact counterpart."""
    log = portfolio.requests_from(monitors.stream_table(spark, d, "events"))
    out = monitors.drained(monitors.windowed_requests(log), "requests")
    return rounded(out.withColumn("day", monitors.utc_day("window_start")).drop("window_start", "p50", "p95", "p99"), 6)


@query("l11_stream_latest", with_ctes("""
, l AS (SELECT event_type, latency, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM requests WHERE NOT rejected)
SELECT event_type, count(latency) AS samples, round(avg(latency),6) AS mean, round(quantile_cont(latency,0.5),6) AS p50, round(quantile_cont(latency,0.95),6) AS p95, round(quantile_cont(latency,0.99),6) AS p99
FROM l WHERE r<=1000 GROUP BY 1"""))
def stream_latest(spark, d):
    """Exact latency percentiles over the newest thousand served requests of each type, kept as state of a stream."""
    log = portfolio.requests_from(monitors.timed(monitors.stream_table(spark, d, "events"))).where("NOT rejected")
    buffers = latest.followed(latest.newest_requests(log, ["event_type"]), work_path(spark, "latest"), ["event_type", "lane"])
    return rounded(latest.latest_figures(buffers, ["event_type"]), 6)


@query("l12_stream_scoring", with_ctes(f"""
, ok AS (SELECT policy_id, CAST({_age} AS INT) AS age, {_bmi} AS bmi, CAST({_kids} AS INT) AS children, smoker, region FROM checked WHERE errors = '')
SELECT policy_id, 'success' AS status, CAST(NULL AS VARCHAR) AS error, {SCORE_SQL} AS risk_score, round({ACT},6) AS premium FROM ok
UNION ALL SELECT policy_id, 'error', errors, NULL, NULL FROM checked WHERE errors <> ''""", checked=CHECKED))
def stream_scoring(spark, d):
    customers = monitors.stream_table(spark, d, "customer")
    policies = portfolio.policies_from(customers, portfolio.table(spark, d, "orders"), portfolio.table(spark, d, "nation"))
    good, bad = scoring.run(portfolio.raw_from(policies))
    return rounded(good.unionByName(bad), {"premium": 6})
