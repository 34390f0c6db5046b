"""Queries on event logs: cooldowns, budgets, adaptive limits, caches, tokens, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import decisions, state
from sparkloom.plans.documents import _literal
from sparkloom.plans.registry import query
from sparkloom.session import table

GAP = 21_600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT user_id, n, t AS last, 1 AS accepted FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t - f.last >= {GAP} THEN e.t ELSE f.last END, f.accepted + CASE WHEN e.t - f.last >= {GAP} THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
  SELECT user_id, max(n)::BIGINT AS events, max(accepted)::BIGINT AS accepted FROM f GROUP BY user_id""")
def evt_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cooldown(_events(spark, sf_dir), ["user_id"], "ts", "event_id", GAP)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type = 'purchase' AS free, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT user_id, 0::BIGINT AS n, NULL::DOUBLE AS last, 0 AS accepted FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT e.user_id, e.n, CASE WHEN NOT free AND (last IS NULL OR t - last >= {GAP}) THEN t ELSE last END, accepted + CASE WHEN free OR last IS NULL OR t - last >= {GAP} THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
  SELECT user_id, max(n)::BIGINT AS events, max(accepted)::BIGINT AS accepted FROM f GROUP BY user_id""")
def evt_cooldown_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases wait for nothing and make nothing wait."""
    return state.cooldown(_events(spark, sf_dir), ["user_id"], "ts", "event_id", GAP, F.col("event_type") == "purchase")


#: An event's value names a token; its type and id say when and for what it is good.
@query("""WITH e AS (SELECT event_id, floor(value)::BIGINT AS token, event_id % 100 AS now, CASE WHEN event_type = 'view' THEN 40 END AS nbf, CASE WHEN event_type = 'click' THEN 60 ELSE 0 END AS ex, CASE WHEN event_type = 'error' THEN 'read' WHEN event_type <> 'signup' THEN 'read write' END AS scope FROM events),
  b AS (SELECT *, CASE WHEN now < nbf THEN 'not yet valid' WHEN ex <> 0 AND now > ex THEN 'expired' WHEN NOT contains(coalesce(scope, ''), 'write') THEN 'missing scope' END AS bad FROM e)
  SELECT event_id, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY token, bad IS NULL ORDER BY event_id) = 1 THEN 'accepted' ELSE 'replay' END) AS outcome FROM b""")
def evt_token_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").withColumn("token", F.floor("value")).withColumn("scope", F.when(kind == "error", "read").when(kind != "signup", "read write"))
    used = state.token_uses(rows, "token", ["event_id"], F.col("event_id") % 100, F.when(kind == "view", 40), F.when(kind == "click", 60).otherwise(0), F.col("scope"), "write")
    return used.select("event_id", "outcome")


#: Requests in order of their ids, so that the clock often runs back; four events share an id.
@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, epoch_us(ts) // 86400000000 AS day, CAST(event_id // 4 % 50 AS VARCHAR) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS n FROM events),
  f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS day, 0.0::DOUBLE AS last, []::VARCHAR[] AS ids, NULL::BIGINT AS on_day, false AS ok FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT user_id, n, CASE WHEN back THEN day ELSE today END, CASE WHEN ok THEN t WHEN back THEN last ELSE since END, CASE WHEN ok THEN list_append(held, r) WHEN back THEN ids ELSE held END, today, ok FROM (
      SELECT *, NOT back AND NOT list_contains(held, r) AND len(held) < 3 AND NOT (since > 0 AND t - since < 3600) AS ok FROM (
        SELECT e.user_id, e.n, e.t, e.r, e.day AS today, f.day, f.last, f.ids, f.day IS NOT NULL AND (e.day < f.day OR e.t < f.last) AS back,
          CASE WHEN f.day IS NULL OR e.day > f.day THEN []::VARCHAR[] ELSE f.ids END AS held, CASE WHEN f.day IS NULL OR e.day > f.day THEN 0.0 ELSE f.last END AS since
        FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
  SELECT user_id, on_day AS day, count(*) FILTER (ok)::BIGINT AS accepted FROM f WHERE n > 0 GROUP BY user_id, on_day""")
def evt_daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("r", F.floor(F.col("event_id") / 4) % 50)
    return state.daily_budget(rows, ["user_id"], "ts", ["event_type", "event_id"], 3, 3600, "r")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  f AS (SELECT o_custkey, n, CASE WHEN p <= 200000 AND p <= 400000 THEN 1 ELSE 0 END AS accepted, CAST(CASE WHEN p <= 200000 THEN p ELSE 0 END AS DECIMAL(18,2)) AS spent FROM o WHERE n = 1
    UNION ALL SELECT o.o_custkey, o.n, f.accepted + CASE WHEN o.p <= 200000 AND f.spent + o.p <= 400000 THEN 1 ELSE 0 END, CAST(f.spent + CASE WHEN o.p <= 200000 AND f.spent + o.p <= 400000 THEN o.p ELSE 0 END AS DECIMAL(18,2))
    FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
  SELECT o_custkey, max(accepted)::BIGINT AS accepted, max(spent)::DOUBLE AS spent FROM f GROUP BY o_custkey""")
def evt_pay_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    return state.spend(orders, ["o_custkey"], "o_orderkey", "p", 200_000, 400_000)


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'throttled' WHEN 'click' THEN 'error' ELSE 'ok' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT user_id, 0::BIGINT AS n, 6 AS lim, 0 AS row, 0 AS ok, 0 AS thr, 0 AS err FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT e.user_id, e.n, CASE WHEN k = 'ok' AND row + 1 >= 5 AND lim < 12 THEN lim + 1 WHEN k = 'throttled' THEN greatest(1, lim // 2) ELSE lim END,
      CASE WHEN k = 'ok' AND NOT (row + 1 >= 5 AND lim < 12) THEN row + 1 ELSE 0 END, ok + (k = 'ok')::INT, CASE k WHEN 'ok' THEN 0 WHEN 'throttled' THEN thr + 1 ELSE thr END, err + (k = 'error')::INT
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
  SELECT user_id, arg_max(lim, n)::BIGINT AS "limit", arg_max(ok, n)::BIGINT AS ok, arg_max(thr, n)::BIGINT AS throttled, arg_max(err, n)::BIGINT AS errors FROM f GROUP BY user_id""")
def evt_aimd(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "throttled").when(F.col("event_type") == "click", "error").otherwise("ok")
    return state.adaptive_limit(_events(spark, sf_dir).withColumn("kind", kind), ["user_id"], ["ts", "event_id"], "kind")


@query("""WITH s AS (SELECT user_id, min((ts, event_id)) AS stored, min(ts) AS since FROM events GROUP BY user_id),
  o AS (SELECT e.user_id, event_type, CASE WHEN (e.ts, e.event_id) = stored THEN 'miss' WHEN epoch_us(e.ts) < epoch_us(since) + 36000000000 THEN 'hit' ELSE 'revalidated' END AS outcome FROM events e JOIN s USING (user_id))
  SELECT user_id, count(*) FILTER (outcome = 'hit')::BIGINT AS hits, count(*) FILTER (outcome = 'revalidated')::BIGINT AS revalidated, count(*) FILTER (outcome = 'miss')::BIGINT AS misses, count(*) FILTER (outcome = 'miss')::BIGINT AS stores,
    coalesce(sum(length(event_type)) FILTER (outcome <> 'miss'), 0)::BIGINT AS bytes_saved FROM o GROUP BY user_id""")
def evt_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.cache_outcomes(_events(spark, sf_dir), "user_id", "ts", "event_id", 36_000.0)
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    saved = F.coalesce(F.sum(F.when(F.col("outcome") != "miss", F.length("event_type"))), F.lit(0)).cast("long")
    return rows.groupBy("user_id").agg(is_("hit").alias("hits"), is_("revalidated").alias("revalidated"), is_("miss").alias("misses"), is_("miss").alias("stores"), saved.alias("bytes_saved"))


@query("""SELECT event_type, count(*) FILTER (n = 1)::BIGINT AS first_uses, count(*) FILTER (n > 1)::BIGINT AS replays
  FROM (SELECT event_type, row_number() OVER (PARTITION BY floor(value) ORDER BY ts, event_id) AS n FROM events) GROUP BY event_type""")
def evt_token_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.first_use(_events(spark, sf_dir).withColumn("token", F.floor("value")), "token", "ts", "event_id")
    return rows.groupBy("event_type").agg(F.count_if(~F.col("replay")).alias("first_uses"), F.count_if(F.col("replay")).alias("replays"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) FILTER (event_type = 'error')::BIGINT AS errors, round(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END), 2)::DOUBLE AS spend FROM events GROUP BY user_id""")
def evt_node_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,4)")).otherwise(F.lit(0).cast("decimal(18,4)"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum(paid), 2).cast("double").alias("spend"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def evt_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "ts")


@query("""SELECT source, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS upto
    FROM (SELECT source, doc_id, octet_length(encode(text)) AS size FROM documents) WHERE size <= 20000) WHERE n <= 30 AND upto <= 60000 GROUP BY source""")
def doc_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return state.admit_prefix(sized, "source", "doc_id", "size", 30, 60_000, 20_000).groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


WAITS = [(1, "120", 3), (2, "0", 1), (3, "Thu, 01 Jan 1970 00:10:00 GMT", 2), (4, "soon", 2), (5, None, 9), (6, "-1", 1)]


@query(f"""SELECT id, coalesce(retry, least(power(2.0, least(throttled, 4)), 10.0))::DOUBLE AS pause FROM (SELECT id, throttled, CASE WHEN regexp_matches(v, '^\\d+(\\.\\d+)?$') THEN v::DOUBLE WHEN regexp_matches(v, 'GMT$')
  THEN greatest(epoch(strptime(regexp_replace(v, '^[A-Za-z]{{3}}, | GMT$', '', 'g'), '%d %b %Y %H:%M:%S')) - 100, 0) END AS retry FROM (VALUES {_literal(WAITS)}) AS w(id, v, throttled))""")
def lit_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(WAITS, "id int, v string, throttled int")
    return rows.select("id", state.pause(state.retry_after(F.col("v"), F.lit(100.0)), F.col("throttled")).cast("double").alias("pause"))


HEADERS = [(1, "max-age=60", 500.0), (2, "max-age=0", 500.0), (3, "no-store, max-age=60", 500.0), (4, None, None), (5, "public", 90.0)]


@query(f"""SELECT id, CASE WHEN regexp_matches(lower(coalesce(cc, '')), 'no-store|no-cache') THEN 0 WHEN TRY_CAST(regexp_extract(lower(coalesce(cc, '')), 'max-age\\s*=\\s*(\\d+)', 1) AS DOUBLE) > 0
  THEN 100 + TRY_CAST(regexp_extract(lower(cc), 'max-age\\s*=\\s*(\\d+)', 1) AS DOUBLE) ELSE coalesce(expires, 0) END::DOUBLE AS fresh_until FROM (VALUES {_literal(HEADERS)}) AS h(id, cc, expires)""")
def lit_fresh_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(HEADERS, "id int, cc string, expires double")
    return rows.select("id", state.fresh_until(F.col("cc"), F.col("expires"), F.lit(100.0)).alias("fresh_until"))


@query("""WITH p AS (SELECT CASE WHEN quality = 1 THEN 'good' END AS e, CASE WHEN length(text) > 600 THEN 'good' END AS f FROM labels JOIN documents USING (doc_id)),
  c AS (SELECT count(*) FILTER (e = 'good' AND f = 'good') AS tp, count(*) FILTER (f IS NOT NULL AND e IS NULL) AS fp, count(*) FILTER (e IS NOT NULL AND f IS NULL) AS fn, count(*) FILTER (e IS NULL AND f IS NULL) AS ab, count(*) FILTER (e IS NULL) AS op FROM p)
  SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, ab::BIGINT AS abstained, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(ab / op, 4) AS abstention FROM c""")
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return decisions.measures(rows, F.when(F.col("quality") == 1, "good"), F.when(F.length("text") > 600, "good"))


ANSWERS = [
    (1, "a", {"a": 0.9, "b": 0.1}, 0.8), (2, "b", {"a": 0.9, "b": 0.1}, 0.8), (3, "a", {"a": 0.9, "b": 0.2}, 0.8), (4, "a", {"a": 0.9, "c": 0.1}, 0.8),
    (5, "a", {"a": 1.2, "b": -0.2}, 0.8), (6, "a", {"a": 0.9, "b": 0.1}, 0.5), (7, "a", {"a": 0.9, "b": 0.12}, 0.8), (8, "a", {"a": float("nan"), "b": 0.1}, 0.8),
]


LABELS = ("a", "b")
ANSWERS_SQL = ", ".join(f"({i}, '{c}', {list(p)}, [{', '.join(repr(v) if v == v else chr(39) + 'nan' + chr(39) + '::DOUBLE' for v in p.values())}], {conf})" for i, c, p, conf in ANSWERS)


REASONS_SQL = f"""(SELECT id, CASE WHEN list_sort(names) <> {list(LABELS)} THEN 'distribution_labels' WHEN len(list_filter(p, lambda x: isnan(x) OR x < 0 OR x > 1)) > 0 THEN 'numeric_range' WHEN abs(list_sum(p) - 1) > 0.020000001 THEN 'distribution_sum' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'numeric_range'
    WHEN coalesce(own < peak, true) THEN 'choice' WHEN abs(confidence - (n * peak - 1) / (n - 1)) > 0.020000001 THEN 'confidence_metric' ELSE '' END AS reason, choice IN ('unknown', 'none') OR confidence < 0.8 AS abstained
  FROM (SELECT *, list_max(p) AS peak, len(p) AS n, p[list_position(names, choice)] AS own FROM (VALUES {ANSWERS_SQL}) AS v(id, choice, names, p, confidence)))"""


@query(f"SELECT event_id, reason, abstained FROM events JOIN {REASONS_SQL} ON event_id % {len(ANSWERS)} + 1 = id")
def evt_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each event."""
    few = spark.createDataFrame(ANSWERS, "id int, choice string, p map<string,double>, confidence double")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(ANSWERS) + 1).cast("int").alias("id")).join(F.broadcast(few), "id")
    return rows.select("event_id", decisions.choice_reason(F.col("choice"), F.col("p"), F.col("confidence"), F.array(*map(F.lit, LABELS))).alias("reason"), decisions.abstained(F.col("choice"), F.col("confidence")).alias("abstained"))


@query(f"SELECT id, reason, abstained FROM {REASONS_SQL}")
def lit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ANSWERS, "id int, choice string, p map<string,double>, confidence double")
    return rows.select("id", decisions.choice_reason(F.col("choice"), F.col("p"), F.col("confidence"), F.array(F.lit("a"), F.lit("b"))).alias("reason"), decisions.abstained(F.col("choice"), F.col("confidence")).alias("abstained"))
