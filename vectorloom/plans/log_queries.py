"""Aggregates, windows and routing over `events` as a request log: value is a duration in ms, "error" a failure, user_id % 8
the node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.operators import routing
from vectorloom.operators.quantiles import quantiles
from vectorloom.plans.registry import query, table
from vectorloom.streaming import metrics

NODES = [f"node-{k}" for k in range(8)]
LOG = "WITH l AS (SELECT event_id, ts, user_id, event_type, value, props, 'node-' || (user_id % 8) AS node, event_type = 'error' AS failed FROM events), "


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("node", F.concat(F.lit("node-"), (F.col("user_id") % 8).cast("string"))).withColumn("failed", F.col("event_type") == "error")


def r(c, name: str):
    return F.round(c, 6).alias(name)


@query("avg_ratio", LOG[:-2] + " SELECT round(coalesce(avg(value) FILTER (event_type = 'none'), 0.0), 6) AS none, round(coalesce(avg(value), 0.0), 6) AS mean FROM l")
def avg_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average with 0 for no rows."""
    return log(spark, sf_dir).agg(r(F.coalesce(F.avg(F.when(F.col("event_type") == "none", F.col("value"))), F.lit(0.0)), "none"), r(F.coalesce(F.avg("value"), F.lit(0.0)), "mean"))


@query("db_stats", "SELECT count(*) AS vectors, count(DISTINCT label) AS labels, count(*) * 64 * 4 AS raw_bytes, max(vec_id) AS last_id FROM embeddings")
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"), (F.count("*") * 64 * 4).alias("raw_bytes"), F.max("vec_id").alias("last_id"))


@query("search_stats", LOG + "x AS (SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM l) SELECT hits, misses, round(hits / greatest(1, hits + misses), 6) AS hit_rate FROM x")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = log(spark, sf_dir).agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return x.select("hits", "misses", r(F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("misses")), "hit_rate"))


@query("latency_summary", LOG[:-2] + " SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(1000 / avg(value), 6) AS per_second FROM l GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    own = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    q = quantiles(rows, ["event_type"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("event_type", "e")
    own = own.join(q, F.col("event_type").eqNullSafe(F.col("e")))
    return own.select("event_type", "n", r(F.col("mean"), "mean"), r(F.col("median"), "median"), r(F.col("p95"), "p95"), r(F.col("p99"), "p99"), r(1000 / F.col("mean"), "per_second"))


@query("histogram", "WITH x AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(20, 1 + floor((value - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n FROM events, x GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bins = F.least(F.lit(20), (1 + F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20)).cast("int"))
    return e.select("value").join(F.broadcast(span), how="cross").groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


@query("group_summary", "SELECT event_type, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, round(max(value), 2) AS most, round(sum(value), 2) AS total FROM events GROUP BY 1")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_samp("value"), 2).alias("std"), F.round(F.max("value"), 2).alias("most"), F.round(F.sum("value"), 2).alias("total"))


NODE = LOG + "n AS (SELECT node, count(*) AS requests, count(*) FILTER (failed) AS errors, avg(value) AS latency, sum(value) AS total, max(ts) AS seen FROM l GROUP BY 1)"


def by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("node").agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"), F.avg("value").alias("latency"), F.sum("value").alias("total"), F.max("ts").alias("seen"))


@query("cluster_info", NODE + " SELECT count(*) AS nodes, count(*) FILTER (errors / requests < 0.21) AS healthy, sum(requests)::BIGINT AS requests, round(avg(latency), 6) AS latency FROM n")
def cluster_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = by_node(spark, sf_dir)
    return n.agg(F.count("*").alias("nodes"), F.count_if(F.col("errors") / F.col("requests") < 0.21).alias("healthy"), F.sum("requests").alias("requests"), r(F.avg("latency"), "latency"))


@query("worker_stats", NODE + " SELECT node, requests, errors, round(latency, 6) AS latency, round(errors / requests, 6) AS error_rate FROM n")
def worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_node(spark, sf_dir).select("node", "requests", "errors", r(F.col("latency"), "latency"), r(F.col("errors") / F.col("requests"), "error_rate"))


@query("query_type_metrics", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) FILTER (value > 50) AS slow FROM events GROUP BY 1")
def query_type_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), r(F.min("value"), "least"), r(F.max("value"), "most"), F.count_if(F.col("value") > 50).alias("slow"))


@query("cluster_performance", LOG[:-2] + " SELECT count(*) AS requests, round(avg(value), 6) AS latency, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) FILTER (failed) / count(*), 6) AS error_rate, round(count(*) / greatest(1, epoch(max(ts)) - epoch(min(ts))), 4) AS per_second FROM l")
def cluster_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real percentiles and rates."""
    span = F.max("ts").cast("double") - F.min("ts").cast("double")
    rows = log(spark, sf_dir)
    own = rows.agg(F.count("*").alias("requests"), r(F.avg("value"), "latency"), r(F.count_if("failed") / F.count("*"), "error_rate"), F.round(F.count("*") / F.greatest(F.lit(1.0), span), 4).alias("per_second"))
    q = quantiles(rows, [], "value", {"p95": 0.95, "p99": 0.99})
    return own.join(q, how="cross").select("requests", "latency", r(F.col("p95"), "p95"), r(F.col("p99"), "p99"), "error_rate", "per_second")


@query("node_rollup", LOG[:-2] + " SELECT node, event_type, count(*) AS n, round(sum(value), 4) AS total FROM l GROUP BY ALL")
def node_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("node", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("rebalance_plan", LOG + "s AS (SELECT node, user_id, count(*)::DOUBLE AS load FROM l WHERE node <> 'node-7' GROUP BY 1, 2), n AS (SELECT 'node-' || k AS node FROM range(8) t(k)), g AS (SELECT n.node, count(s.user_id) AS shards, coalesce(sum(load), 0.0) AS load FROM n LEFT JOIN s USING (node) GROUP BY 1), m AS (SELECT avg(load) AS mean FROM g) SELECT node, shards, round(load, 6) AS load, CASE WHEN load > 1.2 * mean THEN 'overloaded' WHEN load < 0.8 * mean THEN 'underloaded' ELSE 'balanced' END AS state FROM g, m")
def rebalance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are shards; a node without any counts as idle."""
    shards = log(spark, sf_dir).where("node <> 'node-7'").groupBy("node", "user_id").agg(F.count("*").cast("double").alias("load"))
    nodes = spark.createDataFrame([(n,) for n in NODES], "node string")
    return routing.rebalance(nodes, shards).select("node", "shards", r(F.col("load"), "load"), "state")


@query("replication_status", NODE + " SELECT node, requests >= (SELECT max(requests) FROM n) * 0.9 AS in_sync, errors = 0 AS clean FROM n")
def replication_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = by_node(spark, sf_dir)
    most = n.agg(F.max("requests").alias("most"))
    return n.join(F.broadcast(most), how="cross").select("node", (F.col("requests") >= F.col("most") * 0.9).alias("in_sync"), (F.col("errors") == 0).alias("clean"))


@query("scenario_rollup", "SELECT event_type AS scenario, round(avg(value / 10), 6) AS mean_speedup, round(max(value / 10), 6) AS best_speedup, round(avg((value > 20)::INT), 6) AS accuracy FROM events GROUP BY 1")
def scenario_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scenario")).agg(r(F.avg(F.col("value") / 10), "mean_speedup"), r(F.max(F.col("value") / 10), "best_speedup"), r(F.avg((F.col("value") > 20).cast("int")), "accuracy"))


@query("scale_report", NODE + " SELECT max(requests) AS most_requests, round(max(latency), 6) AS worst_latency, count(*) FILTER (latency < 50) AS within FROM n")
def scale_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_node(spark, sf_dir).agg(F.max("requests").alias("most_requests"), r(F.max("latency"), "worst_latency"), F.count_if(F.col("latency") < 50).alias("within"))


# ---- windows


@query("running_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-10, 6) AS mean FROM events")
def running_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of values with two decimals end in a 5 often; a small shift makes both engines round those up."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", r(F.avg("value").over(own) + 1e-10, "mean"))


@query("ema_latency", "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, k, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, 0.9::DOUBLE * f.ema + 0.1::DOUBLE * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM f GROUP BY 1")
def ema_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean, a tenth of each new value, as a sum of weighted values: no ordered fold, and it combines map-side."""
    own = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(own).alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    weight = F.pow(F.lit(0.9), F.col("k") - 1) * F.when(F.col("k") == F.col("n"), 1.0).otherwise(0.1)
    return rows.groupBy("user_id").agg(r(F.sum(F.col("value") * weight), "ema"))


@query("last_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).drop("ts")


@query("cumulative_savings", "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) * 0.3::DOUBLE AS saved FROM events GROUP BY 1) SELECT day, round(saved, 4) AS saved, round(sum(saved) OVER (ORDER BY day), 4) AS total FROM d")
def cumulative_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.sum("value") * 0.3).alias("saved"))
    return days.select("day", F.round("saved", 4).alias("saved"), F.round(F.sum("saved").over(Window.orderBy("day")), 4).alias("total"))


WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"


@query("windowed_metrics", WINDOWS)
def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the stream."""
    return metrics.windowed_metrics(log(spark, sf_dir)).select("start", "event_type", "n", r(F.col("mean"), "mean"))


@query("streamed_metrics", WINDOWS)
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream itself over the table's file, run until it has no more input; the result is what its sink has.  A closing
    row a day behind the last one takes the watermark past every window of the table; its own stays open."""
    import uuid

    from vectorloom.plans.scratch import shared_dir

    at = f"{shared_dir(spark)}/vectorloom/stream-{uuid.uuid4().hex}"
    log(spark, sf_dir).write.parquet(f"{at}/in")
    metrics.closing(log(spark, sf_dir)).write.mode("append").parquet(f"{at}/in")
    events = spark.readStream.schema(log(spark, sf_dir).schema).parquet(f"{at}/in")
    run = metrics.windowed_metrics(events).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    run.awaitTermination()
    out = spark.read.schema("start timestamp, end timestamp, event_type string, n bigint, mean double, least double, most double").parquet(f"{at}/out")
    return out.select("start", "event_type", "n", r(F.col("mean"), "mean"))


# ---- routing

PLACE = "('0x' || substr(md5({}), 1, 15))::BIGINT"
RING = "WITH n AS (SELECT 'node-' || k AS node FROM range(8) t(k)), r AS (SELECT node, " + PLACE.format("node || ':' || i") + " AS position FROM n, range(64) s(i)), x AS (SELECT o_orderkey, " + PLACE.format("o_orderkey::VARCHAR") + " AS place FROM orders), f AS (SELECT o_orderkey, coalesce(arg_min(r.node, r.position) FILTER (r.position >= place), arg_min(r.node, r.position)) AS node FROM x, r GROUP BY 1)"


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return routing.lookup(orders, routing.ring(spark, NODES), F.col("o_orderkey").cast("string"))


@query("ring_lookup", RING + " SELECT o_orderkey, node FROM f")
def ring_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir)


@query("ring_assign", RING + " SELECT node, count(*) AS n FROM f GROUP BY 1")
def ring_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).groupBy("node").agg(F.count("*").alias("n"))


@query("replica_select", RING + ", k AS (SELECT o_orderkey, substr(node, 6)::INT AS i FROM f) SELECT o_orderkey, 'node-' || i || ',node-' || (i + 1) % 8 || ',node-' || (i + 2) % 8 AS replicas FROM k")
def replica_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("o_orderkey", F.array_join(routing.replicas(NODES, F.col("node"), 3), ",").alias("replicas"))


STATE = NODE + ", s AS (SELECT node, requests / (SELECT max(requests) FROM n) AS load, latency, requests % 100 AS connections, 1 - errors / requests AS success FROM n)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = by_node(spark, sf_dir)
    most = n.agg(F.max("requests").alias("most"))
    return n.join(F.broadcast(most), how="cross").select("node", (F.col("requests") / F.col("most")).alias("load"), "latency", (F.col("requests") % 100).alias("connections"), (1 - F.col("errors") / F.col("requests")).alias("success"))


@query("load_aware", STATE + " SELECT node, round(0.4 * load + 0.3 * latency / 1000 + 0.2 * connections / 100 + 0.1 * (1 - success), 6) AS score FROM s ORDER BY 0.4 * load + 0.3 * latency / 1000 + 0.2 * connections / 100 + 0.1 * (1 - success), node LIMIT 1")
def load_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = states(spark, sf_dir).withColumn("score", routing.load_score(F.col("load"), F.col("latency"), F.col("connections"), F.col("success")))
    return own.orderBy("score", "node").limit(1).select("node", r(F.col("score"), "score"))


@query("node_weight", STATE + " SELECT node, round(least(3.0, greatest(0.1, 2 * success * (2 - least(load, 2)) * (2 - least(latency / 500, 2)))), 6) AS weight FROM s")
def node_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("node", r(routing.node_weight(F.col("load"), F.col("latency"), F.col("success")), "weight"))


@query("round_robin", "SELECT event_id, 'node-' || ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 8) AS node FROM events")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's requests in turn to the nodes."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("node-"), ((F.row_number().over(own) - 1) % 8).cast("string")).alias("node"))


@query("least_connections", STATE + " SELECT node FROM s ORDER BY connections, node LIMIT 1")
def least_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).orderBy("connections", "node").limit(1).select("node")


@query("hash_select", "SELECT o_orderkey, 'node-' || (" + PLACE.format("o_orderkey::VARCHAR") + " % 8) AS node FROM orders")
def hash_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", routing.hashed(NODES, F.col("o_orderkey").cast("string")).alias("node"))


@query("range_partition", "WITH x AS (SELECT o_orderkey, " + PLACE.format("o_orderkey::VARCHAR") + " AS p FROM orders) SELECT o_orderkey, CASE WHEN p <= 7 * (1::BIGINT << 57) THEN ((p + (1::BIGINT << 57) - 1) // (1::BIGINT << 57) - 1)::INT ELSE -1 END AS part FROM x")
def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven bounds an eighth of the ring apart; the last eighth has none."""
    bounds = [(k + 1) << 57 for k in range(7)]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(routing.by_range(bounds, F.col("o_orderkey").cast("string")), F.lit(-1)).alias("part"))


@query("weighted_select", STATE + ", w AS (SELECT node, round(least(3.0, greatest(0.1, 2 * success * (2 - least(load, 2)) * (2 - least(latency / 500, 2)))), 6)::DOUBLE AS weight FROM s), c AS (SELECT node, sum(weight) OVER (ORDER BY node) AS upto, sum(weight) OVER (ORDER BY node) - weight AS low FROM w), x AS (SELECT event_id, " + PLACE.format("event_id::VARCHAR") + " / (1::BIGINT << 60)::DOUBLE * (SELECT max(upto) FROM c) AS spot FROM events) SELECT event_id, node FROM x JOIN c ON spot >= low AND spot < upto")
def weighted_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = node_weight(spark, sf_dir)
    return routing.weighted(table(spark, sf_dir, "events").select("event_id"), own, F.col("event_id").cast("string"))


@query("healthy_nodes", NODE + " SELECT node FROM n WHERE errors / requests < 0.25 AND requests > 0 AND epoch((SELECT max(seen) FROM n)) - epoch(seen) <= 3600")
def healthy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = by_node(spark, sf_dir)
    now = n.agg(F.max("seen").alias("now"))
    own = n.join(F.broadcast(now), how="cross").withColumn("breaker", F.when(F.col("errors") / F.col("requests") < 0.25, "closed").otherwise("open")).withColumn("status", F.when(F.col("requests") > 0, "healthy").otherwise("down"))
    return routing.healthy(own.withColumn("checked_at", F.col("seen")), F.col("now"), 3600).select("node")


@query("healthy_gauge", NODE + " SELECT count(*) FILTER (latency / 100 < 0.9 AND errors / requests < 0.21) AS healthy, count(*) AS nodes FROM n")
def healthy_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_node(spark, sf_dir).agg(F.count_if((F.col("latency") / 100 < 0.9) & (F.col("errors") / F.col("requests") < 0.21)).alias("healthy"), F.count("*").alias("nodes"))


@query("alerts", LOG[:-2] + " SELECT DISTINCT node || ':' || CASE WHEN value > 90 THEN 'slow' ELSE 'error' END AS alert_id, CASE WHEN value > 90 THEN 'warning' ELSE 'critical' END AS severity FROM l WHERE value > 90 OR failed")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = F.col("value") > 90
    own = log(spark, sf_dir).where(slow | F.col("failed"))
    own = own.select(F.concat("node", F.lit(":"), F.when(slow, "slow").otherwise("error")).alias("alert_id"), F.when(slow, "warning").otherwise("critical").alias("severity"))
    return own.dropDuplicates(["alert_id"])


BREAKER = """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS k FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'closed' AS state, 0 AS bad, 0 AS good, 0::BIGINT AS since FROM events
UNION ALL SELECT user_id, k, state, CASE WHEN was = 'closed' AND failed THEN bad + 1 ELSE 0 END, CASE WHEN state = 'half_open' THEN good + 1 ELSE 0 END, CASE WHEN state = 'open' AND was <> 'open' THEN t ELSE since END FROM (
SELECT *, CASE was WHEN 'closed' THEN CASE WHEN failed AND bad >= 1 THEN 'open' ELSE 'closed' END WHEN 'open' THEN 'open' ELSE CASE WHEN failed THEN 'open' WHEN good >= 1 THEN 'closed' ELSE 'half_open' END END AS state FROM (
SELECT o.user_id, o.k, o.t, o.failed, s.bad, s.good, s.since, CASE WHEN s.state = 'open' AND o.t - s.since >= 3600000000 THEN 'half_open' ELSE s.state END AS was FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)))
SELECT state, count(*) AS n FROM s WHERE k > 0 GROUP BY 1"""
BUCKET = """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
s AS (SELECT user_id, 1::BIGINT AS k, t, 2.0::DOUBLE AS tokens, true AS allowed FROM o WHERE k = 1
UNION ALL SELECT user_id, k, t, tokens - (tokens >= 1)::INT, tokens >= 1 FROM (
SELECT o.user_id, o.k, o.t, least(3.0::DOUBLE, s.tokens + 1::DOUBLE / 7200 * ((o.t - s.t) / 1e6)) AS tokens FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1))
SELECT allowed, count(*) AS n FROM s GROUP BY 1"""


@query("breaker_fsm", BREAKER)
def breaker_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.breaker(log(spark, sf_dir), "user_id", "ts", "failed", failures=2, timeout_s=3600, successes=2).groupBy("state").agg(F.count("*").alias("n"))


@query("token_bucket", BUCKET)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.token_bucket(log(spark, sf_dir), "user_id", "ts", rate=1 / 7200, burst=3.0).groupBy("allowed").agg(F.count("*").alias("n"))


# ---- json, dates, arithmetic


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::INT AS size FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("size"))


@query("json_like", "SELECT count(*) AS n FROM events WHERE props LIKE '%1%'")
def json_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("props").like("%1%")).agg(F.count("*").alias("n"))


@query("string_dates", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-05' AND strftime(ts, '%Y-%m-%d') < '2024-01-20' GROUP BY 1")
def string_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return own.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("tags_map", "SELECT event_type, count(*) AS n FROM events WHERE (user_id % 3)::VARCHAR = '1' GROUP BY 1")
def tags_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("tags", F.create_map(F.lit("tier"), (F.col("user_id") % 3).cast("string"), F.lit("kind"), F.col("event_type")))
    return own.where(F.col("tags")["tier"] == "1").groupBy(F.col("tags")["kind"].alias("event_type")).agg(F.count("*").alias("n"))


@query("cost_roi", "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS cost FROM events GROUP BY 1) SELECT day, round(cost * 0.7::DOUBLE, 4) AS savings, round((cost * 0.7::DOUBLE * 12 - 1000) / 1000 * 100, 3) AS roi_percent, round(1000 / (cost * 0.7::DOUBLE), 6) AS payback_months FROM d")
def cost_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("cost"))
    savings = F.col("cost") * 0.7
    return days.select("day", F.round(savings, 4).alias("savings"), F.round((savings * 12 - 1000) / 1000 * 100, 3).alias("roi_percent"), r(1000 / savings, "payback_months"))


@query("cache_perf", LOG + "n AS (SELECT node, count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type <> 'view') AS m FROM l GROUP BY 1) SELECT node, round((h * 50 + m * 400) / (h + m), 6) AS response_ms FROM n")
def cache_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = log(spark, sf_dir).groupBy("node").agg(F.count_if(F.col("event_type") == "view").alias("h"), F.count_if(F.col("event_type") != "view").alias("m"))
    return n.select("node", r((F.col("h") * 50 + F.col("m") * 400) / (F.col("h") + F.col("m")), "response_ms"))
