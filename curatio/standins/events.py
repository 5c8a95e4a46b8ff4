"""Event-graph queries over ``events``.

Stand-in mapping: a user's events in ``(ts, event_id)`` order are cut into event
graphs of at most 10 nodes (``graph_idx = pos div 10``, node ``id = pos % 10 + 1``),
so a graph stays small however many events one user has. Node text is
``'<event_type> #<event_id>'``, date ``yyyy.MM.dd`` of ``ts``; a node's parent is the
previous node. Planted defects for validation come from the ``props`` JSON ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.operators.position import default_buckets, positions, quantile_bucket
from curatio.plans import events as EV
from curatio.sources.testdata import Tables
from curatio.standins.registry import query

GRAPH = 10


def _ts_seconds(c) -> F.Column:
    """Seconds since 1970 of a TIMESTAMP_NTZ from its fields (no time-zone involved)."""
    ts = F.col(c)
    return (F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double") * 86400.0
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def nodes(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type", "props").withColumn("_sec", _ts_seconds("ts"))
    n = e.count()
    p = positions(e, ["ts", "event_id"], quantile_bucket(e, "_sec", default_buckets(n, 50_000)),
                  group=["user_id"], pos_col="pos")
    return p.select(
        "user_id", (F.col("pos") / GRAPH).cast("bigint").alias("graph_idx"),
        (F.col("pos") % GRAPH).cast("bigint").alias("node_pos"), "event_id", "ts",
        F.concat("event_type", F.lit(" #"), F.col("event_id").cast("string")).alias("event"),
        F.date_format("ts", "yyyy.MM.dd").alias("date"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


NODES_SQL = f"""n0 AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events
), nodes AS (
  SELECT user_id, CAST(pos // {GRAPH} AS BIGINT) AS graph_idx, CAST(pos % {GRAPH} AS BIGINT) AS node_pos, event_id, ts,
         event_type || ' #' || CAST(event_id AS VARCHAR) AS event, strftime(ts, '%Y.%m.%d') AS date,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM n0
)"""


@query("event_nodes", f"""WITH {NODES_SQL}
SELECT user_id, graph_idx, node_pos + 1 AS node_id, event, date,
       CASE WHEN node_pos = 0 THEN -1 ELSE node_pos END AS parent_id FROM nodes""")
def event_nodes(spark, sf_dir):
    n = nodes(Tables(spark, sf_dir).events)
    return n.select("user_id", "graph_idx", (F.col("node_pos") + 1).alias("node_id"), "event", "date",
                    F.when(F.col("node_pos") == 0, -1).otherwise(F.col("node_pos")).cast("bigint").alias("parent_id"))


@query("event_history", f"""WITH {NODES_SQL}
SELECT user_id, graph_idx, node_pos + 1 AS session_number, event, date,
  lag(date) OVER w AS last_date,
  coalesce(string_agg('- ' || date || ': ' || event, chr(10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history_before,
  string_agg('- ' || date || ': ' || event, chr(10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history_event
FROM nodes WINDOW w AS (PARTITION BY user_id, graph_idx ORDER BY node_pos)""")
def event_history(spark, sf_dir):
    v = EV.session_views(nodes(Tables(spark, sf_dir).events), ["user_id", "graph_idx"])
    return v.select("user_id", "graph_idx", "session_number", "event", "date", "last_date", "history_before",
                    "history_event")


@query("session_eligibility", f"""WITH {NODES_SQL},
g AS (SELECT user_id, graph_idx, count(*) AS n_events FROM nodes GROUP BY 1, 2)
SELECT CAST(t AS BIGINT) AS target_session, count(*) FILTER (WHERE n_events >= t) AS n_graphs,
       count(DISTINCT user_id) FILTER (WHERE n_events >= t) AS n_users, max(n_events) AS max_events,
       CAST(max(n_events) >= t AS BIGINT) AS stage_runs
FROM g, range(1, 7) r(t) GROUP BY t""")
def session_eligibility(spark, sf_dir):
    g = nodes(Tables(spark, sf_dir).events).groupBy("user_id", "graph_idx").agg(F.count("*").alias("n_events"))
    # the six targets are a generator column, not a join: each graph row fans out to 6 rows
    t = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("target_session"))
    ok = F.col("n_events") >= F.col("target_session")
    return t.groupBy("target_session").agg(
        F.count_if(ok).alias("n_graphs"),
        F.count_distinct(F.when(ok, F.col("user_id"))).alias("n_users"),
        F.max("n_events").alias("max_events")) \
        .withColumn("stage_runs", (F.col("max_events") >= F.col("target_session")).cast("bigint")) \
        .withColumn("target_session", F.col("target_session").cast("bigint"))


@query("event_contract", f"""WITH {NODES_SQL},
e AS (
  SELECT user_id, graph_idx, node_pos, date, ts, lag(ts) OVER w AS pts, lag(date) OVER w AS pdate
  FROM nodes WINDOW w AS (PARTITION BY user_id, graph_idx ORDER BY node_pos)
), i AS (
  SELECT *, CASE WHEN date_diff('day', CAST(pts AS DATE), CAST(ts AS DATE)) = 0
                 THEN CAST(date_sub('hour', pts, ts) AS VARCHAR) || ' hour'
                 ELSE CAST(date_diff('day', CAST(pts AS DATE), CAST(ts AS DATE)) AS VARCHAR) || ' day' END AS time_interval
  FROM e WHERE node_pos > 0
)
SELECT user_id, graph_idx, node_pos + 1 AS node_id, date, time_interval,
  CAST(regexp_extract(time_interval, '(\\d+) (hour|day|week|month|year)', 1) AS BIGINT) AS interval_n,
  regexp_extract(time_interval, '(\\d+) (hour|day|week|month|year)', 2) AS interval_unit,
  CAST(CAST(strptime(pdate, '%Y.%m.%d') AS DATE) <= CAST(strptime(date, '%Y.%m.%d') AS DATE)
       AND year(CAST(strptime(date, '%Y.%m.%d') AS DATE)) <= 2024 AS BIGINT) AS consistent
FROM i""")
def event_contract(spark, sf_dir):
    from pyspark.sql import Window
    n = nodes(Tables(spark, sf_dir).events)
    w = Window.partitionBy("user_id", "graph_idx").orderBy("node_pos")
    e = n.withColumn("pts", F.lag("ts").over(w)).withColumn("pdate", F.lag("date").over(w)).filter("node_pos > 0")
    days = F.date_diff(F.to_date("ts"), F.to_date("pts"))
    interval = F.when(days == 0, F.concat(F.timestamp_diff("HOUR", "pts", "ts").cast("string"), F.lit(" hour"))) \
        .otherwise(F.concat(days.cast("string"), F.lit(" day")))
    e = e.withColumn("time_interval", interval)
    num, unit = EV.interval_parts("time_interval")
    d, pd_ = EV.date_of("date"), EV.date_of("pdate")
    return e.select("user_id", "graph_idx", (F.col("node_pos") + 1).alias("node_id"), "date", "time_interval",
                    num.alias("interval_n"), unit.alias("interval_unit"),
                    ((pd_ <= d) & (F.year(d) <= 2024)).cast("bigint").alias("consistent"))


def graph_generations(n: DataFrame) -> DataFrame:
    """Literal text of each graph with planted defects (see module doc)."""
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    kd = F.col("k") % 10
    root = F.col("node_pos") == 0
    edge_id_key = F.when(kd == 2, F.lit("caused_by_id")).otherwise(F.lit("caused_by:id"))
    edge = F.when(root, F.lit("{}")).otherwise(F.concat(
        F.lit("{'"), edge_id_key, F.lit("': "), F.col("node_pos").cast("string"),
        F.lit(", 'caused_by:time_interval': '1 day'"),
        F.when(kd == 4, F.lit("")).otherwise(F.lit(", 'caused_by:experience_op': 'cause'")),
        F.lit(", 'caused_by:experience': "), q(F.concat(F.lit("after "), F.col("prev_event"))), F.lit("}")))
    number = (F.col("node_pos") + 1).cast("string")
    number = F.when(root & (kd == 6), q(number)).otherwise(number)          # the text '1' is no root id
    caused = F.when(kd == 8, F.lit("caused_by:")).otherwise(F.lit("caused_by"))
    node = F.concat(F.lit("{'id': "), number, F.lit(", 'event': "), q(F.col("event")),
                    F.when(kd == 0, F.lit("")).otherwise(F.concat(F.lit(", 'date': "), q(F.col("date")))),
                    F.lit(", '"), caused, F.lit("': "), edge, F.lit("}"))
    from pyspark.sql import Window
    w = Window.partitionBy("user_id", "graph_idx").orderBy("node_pos")
    n = n.withColumn("prev_event", F.lag("event").over(w)).withColumn("node_text", node)
    g = n.groupBy("user_id", "graph_idx").agg(
        F.count("*").alias("n_nodes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_pos", "node_text"))),
                                 lambda x: x["node_text"]), ", ").alias("body"))
    gk = F.col("user_id") + F.col("graph_idx")
    lst = F.concat(F.lit("["), F.col("body"), F.when(gk % 13 == 0, F.lit(", true")).otherwise(F.lit("")), F.lit("]"))
    lst = F.when(gk % 11 == 5, F.concat(F.lit("{'nodes': "), lst, F.lit("}"))).otherwise(lst)
    gen = F.when(gk % 7 == 3, F.concat(F.lit("```json\n"), lst, F.lit("\n```\nHope this helps."))).otherwise(lst)
    return g.select("user_id", "graph_idx", "n_nodes", gen.alias("generation"))


def _validate_sql(defect: str) -> str:
    return f"""WITH {NODES_SQL},
g AS (
  SELECT user_id, graph_idx, count(*) AS n_nodes, bool_or({defect}) AS key_defect,
         string_agg(event || ' @ ' || date, ' ; ' ORDER BY node_pos) AS events,
         string_agg(CASE WHEN node_pos = 0 THEN 'root' ELSE CAST(node_pos AS VARCHAR) END, ',' ORDER BY node_pos) AS parents
  FROM nodes GROUP BY 1, 2
), v AS (
SELECT *, CASE WHEN (user_id + graph_idx) % 13 = 0 THEN 'syntax:fail' WHEN (user_id + graph_idx) % 11 = 5 THEN 'not_a_list'
       WHEN key_defect THEN 'key:fail' ELSE 'ok' END AS verdict FROM g)
SELECT user_id, graph_idx, n_nodes, verdict, CASE WHEN verdict = 'ok' THEN events END AS events,
       CASE WHEN verdict = 'ok' THEN parents END AS parents FROM v"""


def _validated(spark, sf_dir, repair: bool) -> DataFrame:
    """Verdict of every graph and, of the accepted ones, what was parsed: events, dates and parent ids."""
    res = EV.event_parse(graph_generations(nodes(Tables(spark, sf_dir).events)), repair=repair).annotated
    edge = lambda m: F.from_json(m["caused_by"], "map<string,string>")
    ok = F.col("reject_reason").isNull()
    events = F.array_join(F.transform("nodes", lambda m: F.concat(m["event"], F.lit(" @ "), m["date"])), " ; ")
    parents = F.array_join(F.transform("nodes", lambda m: F.coalesce(edge(m)["caused_by:id"], F.lit("root"))), ",")
    return res.select("user_id", "graph_idx", "n_nodes", F.coalesce("reject_reason", F.lit("ok")).alias("verdict"),
                      F.when(ok, events).alias("events"), F.when(ok, parents).alias("parents"))


@query("event_validate", _validate_sql("k % 10 IN (0, 8) OR (node_pos > 0 AND k % 10 IN (2, 4)) OR (node_pos = 0 AND k % 10 = 6)"))
def event_validate(spark, sf_dir):
    return _validated(spark, sf_dir, repair=False)


@query("event_validate_repaired", _validate_sql("k % 10 = 0 OR (node_pos > 0 AND k % 10 = 4) OR (node_pos = 0 AND k % 10 = 6)"))
def event_validate_repaired(spark, sf_dir):
    return _validated(spark, sf_dir, repair=True)


@query("event_report", f"""WITH v AS ({_validate_sql("k % 10 IN (0, 8) OR (node_pos > 0 AND k % 10 IN (2, 4)) OR (node_pos = 0 AND k % 10 = 6)")})
SELECT 'event' AS stage, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'total' AS metric, count(*) AS value FROM v
  UNION ALL SELECT 'syntax:fail', count(*) FILTER (WHERE verdict = 'syntax:fail') FROM v
  UNION ALL SELECT 'not_a_list', count(*) FILTER (WHERE verdict = 'not_a_list') FROM v
  UNION ALL SELECT 'key:fail', count(*) FILTER (WHERE verdict = 'key:fail') FROM v
  UNION ALL SELECT 'parsed', count(*) FILTER (WHERE verdict = 'ok') FROM v)""")
def event_report(spark, sf_dir):
    return EV.event_parse(graph_generations(nodes(Tables(spark, sf_dir).events))).report
