"""C5 event graphs and the session-side views of them (C8: W2-W4, F5; X22).

An event graph is a list of nodes ``{id, event, date, caused_by:
{caused_by:id, caused_by:time_interval, caused_by:experience_op, caused_by:experience}}``; the root
(id 1) has no edge.
Node tables are exploded graph rows; sessions follow node order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.functions import text as T
from curatio.functions.literal import parse_literal
from curatio.operators.core import report

# fixed values: node and edge keys of an event graph
NODE_KEYS = ["id", "event", "date", "caused_by"]
EDGE_KEYS = ["caused_by:id", "caused_by:time_interval", "caused_by:experience_op", "caused_by:experience"]
# Spellings repaired to the canonical keys
NODE_KEY_REPAIRS = {"caused_by:": "caused_by"}
EDGE_KEY_REPAIRS = {k.replace(":", "_"): k for k in EDGE_KEYS}


def repair_keys(m: Column, repairs: dict[str, str]) -> Column:
    """The map with each wrong spelling renamed, unless the right key is there too."""
    keys = F.map_keys(m)
    right = F.create_map(*[F.lit(x) for pair in repairs.items() for x in pair])
    return F.transform_keys(m, lambda k, _v: F.when(
        F.map_contains_key(right, k) & ~F.array_contains(keys, right[k]), right[k]).otherwise(k))


def repair_nodes(nodes: Column) -> Column:
    """P7 on a graph's nodes ``ARRAY<MAP<STRING,STRING>>``: node keys, then the keys inside ``caused_by``."""
    def one(m):
        m = repair_keys(m, NODE_KEY_REPAIRS)
        return F.transform_values(m, lambda k, v: F.when((k == "caused_by") & F.from_json(
            v, "map<string,string>").isNotNull(), F.to_json(repair_keys(F.from_json(v, "map<string,string>"), EDGE_KEY_REPAIRS)))
            .otherwise(v))
    return F.transform(nodes, one)


def graph_is_valid(nodes: Column, id_int: Column) -> Column:
    """every node has the 4 node keys; every node but the root (the integer id 1; a text '1'
    is no root) has the 4 ``caused_by:`` keys. ``id_int``: per node, whether its id is an integer."""
    pairs = F.zip_with(nodes, id_int, lambda m, i: F.struct(
        m.alias("m"), i.alias("i"), F.from_json(m["caused_by"], "map<string,string>").alias("e")))

    def has(m, names):
        out = F.lit(True)
        for k in names:
            out = out & F.coalesce(F.map_contains_key(m, k), F.lit(False))
        return out
    return F.forall(pairs, lambda x: has(x["m"], NODE_KEYS) & (
        F.coalesce((x["m"]["id"] == "1") & x["i"], F.lit(False)) | has(x["e"], EDGE_KEYS)))


@dataclass
class EventParse:
    annotated: DataFrame  # every graph with ``reject_reason`` (NULL = accepted): one parse pass
    parsed: DataFrame     # graphs that passed, with ``nodes ARRAY<MAP<STRING,STRING>>``
    rejected: DataFrame   # with ``reject_reason``
    report: DataFrame


def event_parse(gen: DataFrame, generation_col: str = "generation", repair: bool = False) -> EventParse:
    """C5 parse: fence strip (X5a) → literal parse (X6) → reject syntax / non-list
    → with ``repair`` the keys are repaired first (P7) → key validation (F6) → report (A1)."""
    p = gen.withColumn("_lit", parse_literal(T.strip_json_fence(generation_col)))
    nodes = F.from_json(F.col("_lit.js"), "array<map<string,string>>")
    nodes = repair_nodes(nodes) if repair else nodes
    p = p.withColumn("nodes", F.when(F.col("_lit.shape") == "list", nodes))
    reason = (F.when(F.col("_lit.err").isNotNull(), F.lit("syntax:fail"))
              .when(F.col("_lit.shape") != "list", F.lit("not_a_list"))
              .when(~graph_is_valid(F.col("nodes"), F.col("_lit.id_int")), F.lit("key:fail")))
    p = p.withColumn("reject_reason", reason)
    rep = report(p, "event", {
        "total": F.count("*"),
        "syntax:fail": F.count_if(F.col("reject_reason") == "syntax:fail"),
        "not_a_list": F.count_if(F.col("reject_reason") == "not_a_list"),
        "key:fail": F.count_if(F.col("reject_reason") == "key:fail"),
        "parsed": F.count_if(F.col("reject_reason").isNull()),
    })
    return EventParse(p.drop("_lit"), p.filter(F.col("reject_reason").isNull()).drop("_lit", "reject_reason"),
                      p.filter(F.col("reject_reason").isNotNull()).drop("_lit"), rep)


def session_views(nodes: DataFrame, graph_key: list[str]) -> DataFrame:
    """W2/W3/W4 on an exploded node table ``(graph_key…, node_pos, event, date)``:
    ``session_number = node_pos + 1``, ``last_date`` = previous node's date,
    ``history_before`` = '- date: event' lines of earlier nodes (the prompt's),
    ``history_event`` = the same including the current node (the source's column)."""
    others = [c for c in nodes.columns if c not in graph_key]
    row = F.struct("node_pos", *[c for c in others if c != "node_pos"])
    graph = nodes.groupBy(*graph_key).agg(F.array_sort(F.collect_list(row)).alias("_n"))
    lines = F.transform("_n", lambda n: F.concat(F.lit("- "), n["date"], F.lit(": "), n["event"]))
    # one array of lines per graph, sliced per node (null lines drop out, as a missing date or event has none)
    x = graph.withColumn("_lines", lines).select(*graph_key, "_n", "_lines", F.posexplode("_n").alias("_i", "_r"))
    upto = lambda n: F.array_join(F.slice("_lines", F.lit(1), n), "\n")
    return x.select(
        *graph_key, *[F.col(f"_r.{c}").alias(c) for c in others], (F.col("_r.node_pos") + 1).cast("bigint").alias("session_number"),
        F.get("_n", F.col("_i") - 1)["date"].alias("last_date"), F.get("_n", F.col("_i") - 1)["event"].alias("last_event"),
        upto(F.col("_i")).alias("history_before"), upto(F.col("_i") + 1).alias("history_event"))


def eligible(graphs: DataFrame, target_session: int, size_col: str = "n_events") -> DataFrame:
    """graphs with at least ``target_session`` events."""
    return graphs.filter(F.col(size_col) >= target_session)


# fixed value: the interval format
INTERVAL_RE = r"(\d+) (hour|day|week|month|year)"


def interval_parts(c) -> tuple[Column, Column]:
    """``'<n> <unit>'`` → (n, unit)."""
    c = T.col_(c)
    return (F.regexp_extract(c, INTERVAL_RE, 1).try_cast("bigint"), F.regexp_extract(c, INTERVAL_RE, 2))


def date_of(c) -> Column:
    """``yyyy.MM.dd`` text → DATE (NULL when malformed)."""
    return F.to_date(F.try_to_timestamp(T.col_(c), F.lit("yyyy.MM.dd")))


def event_requests(narr: DataFrame, name_col: str = "name", narrative_col: str = "narrative") -> DataFrame:
    """C5 requests."""
    from curatio import constants as K
    return narr.withColumn("event_prompt", T.render(K.EVENT_TEMPLATE, name=name_col, event=narrative_col))


def session_requests(sessions: DataFrame) -> DataFrame:
    """C8/C8b requests for every session at once: session 1 uses the first-session
    template, later sessions the next-session one with the earlier events'
    history, the previous date, the interval and the experience."""
    from curatio import constants as K
    common = dict(name="name", age="age", gender="gender", birthplace="birthplace", residence="residence",
                  mobile_device="mobile_device", date="date", event="event")
    first = T.render(K.FIRST_DIALOGUE_TEMPLATE, **common)
    nxt = T.render(K.NEXT_DIALOGUE_TEMPLATE, history_event="history_before", time_interval="time_interval",
                   last_date="last_date", experience="experience", **common)
    return sessions.withColumn("dialogue_prompt", F.when(F.col("session_number") == 1, first).otherwise(nxt))


def session_requests_for(sessions: DataFrame, graph_key: list[str], target_session: int) -> DataFrame:
    """C8 as the source runs it: one target session ``n`` at a time, only for graphs
    with at least ``n`` events (F5); the stage is empty when no graph is that long.
    A graph has a row with ``session_number = n`` exactly when it has ≥ n events, so
    the eligibility test is this filter (no size aggregate, no join)."""
    return session_requests(sessions.filter(F.col("session_number") == target_session))
