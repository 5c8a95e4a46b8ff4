"""§2.12: the extension point. A stage is a value (its inputs, a request builder, a parser); a registry holds the
library's stages, a resolver orders them, and ``run`` takes them from tables to tables.

One stage is one job over its requests: requests are joined with the first completion of each (J13), parsed
once, and every row goes to its outcome (``accepted``, ``rejected``, ``pending``) in a single partitioned write
whose metrics ride along (U4, K5, K4: ``write_split``). The next stage reads the accepted rows back, so the plan
of a stage never grows with the stages before it, and a run that was broken off goes on behind the last stage
whose report is written.

Iterated stages (C8: session n from session n-1) run the same way, one folder per round, with the accepted rows
of a round as the only state of the next (``run_rounds``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatio.operators.core import dedupe_first, observe_report
from curatio.sources.io import read_or_empty

ACCEPTED, REJECTED, PENDING = "accepted", "rejected", "pending"
COMPLETION = ["generation", "prompt_tokens", "completion_tokens"]


@dataclass(frozen=True)
class Stage:
    """``requests(*inputs)`` gives rows with ``request_id`` and a prompt; ``parse(rows)`` gets them with their
    ``generation`` and adds ``reject_reason`` (null: accepted), one row or several for each.

    ``needs`` names the inputs: earlier stages (their accepted rows) or given tables. ``metrics`` names conditions
    (SQL) whose rows the report counts."""
    name: str
    needs: tuple[str, ...]
    requests: Callable[..., DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    metrics: dict[str, str] = field(default_factory=dict)


REGISTRY: dict[str, Stage] = {}


def register(stage: Stage, registry: dict[str, Stage] = REGISTRY) -> Stage:
    if stage.name in registry:
        raise KeyError(f"stage {stage.name!r} is registered already")
    registry[stage.name] = stage
    return stage


def resolve(target: str, tables: set[str], registry: dict[str, Stage] = REGISTRY) -> list[Stage]:
    """The stages ``target`` needs, each behind its inputs, ``target`` last."""
    order: list[Stage] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in tables or any(s.name == name for s in order):
            return
        if name in open_:
            raise ValueError("stages need each other: " + " -> ".join([*open_, name]))
        if name not in registry:
            raise KeyError(f"{name!r} is neither a stage nor a given table" + (f" (needed by {open_[-1]!r})" if open_ else ""))
        open_.append(name)
        for need in registry[name].needs:
            visit(need)
        open_.pop()
        order.append(registry[name])

    visit(target)
    return order


@dataclass
class Outcome:
    """What a stage has written: rows by outcome, and its report ``(stage, metric, value)``."""
    accepted: DataFrame
    rejected: DataFrame
    pending: DataFrame
    report: DataFrame
    path: str


REPORT = "stage string, metric string, value bigint"


def write_split(rows: DataFrame, path: str, stage: str, metrics: dict[str, str] | None = None,
                outcome_col: str = "outcome") -> Outcome:
    """U4/K5/K4: all outcomes and the report from one pass over ``rows``. The report is written last: a folder
    with a report is complete."""
    counted = {"total": F.count("*"), **{o: F.count_if(F.col(outcome_col) == o) for o in (ACCEPTED, REJECTED, PENDING)},
               **{m: F.count_if(F.expr(cond)) for m, cond in (metrics or {}).items()}}
    observed, read = observe_report(rows, stage, counted)
    observed.write.mode("overwrite").partitionBy(outcome_col).parquet(f"{path}/rows")
    spark = rows.sparkSession
    values = read()
    spark.createDataFrame([(stage, m, int(values[m] or 0)) for m in counted], REPORT).coalesce(1).write.mode("overwrite").parquet(f"{path}/report")
    return read_split(spark, path, rows.schema, outcome_col)


def read_split(spark: SparkSession, path: str, schema: StructType, outcome_col: str = "outcome") -> Outcome:
    """What ``write_split`` wrote; each outcome reads its own folder only."""
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    part = lambda o: rows.filter(F.col(outcome_col) == o).drop(outcome_col)
    return Outcome(part(ACCEPTED), part(REJECTED), part(PENDING), spark.read.schema(REPORT).parquet(f"{path}/report"), path)


def is_complete(spark: SparkSession, path: str) -> bool:
    return not read_or_empty(spark, f"{path}/report", REPORT).isEmpty()


def outcomes(requests: DataFrame, completions: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests with their first completion, parsed once: column ``outcome`` beside ``reject_reason``."""
    kept = [c for c in COMPLETION if c in completions.columns]
    first = dedupe_first(completions.select("request_id", "seq", *kept), ["request_id"], ["seq", *kept]).drop("seq")
    joined = requests.join(first.withColumn("_called", F.lit(True)), "request_id", "left")
    parsed = parse(joined)
    outcome = F.when(F.col("_called").isNull(), PENDING).when(F.col("reject_reason").isNull(), ACCEPTED).otherwise(REJECTED)
    return parsed.withColumn("outcome", outcome).withColumn("reject_reason", F.when(F.col("_called").isNotNull(), F.col("reject_reason"))) \
        .drop("_called")


Completions = Callable[[str, DataFrame], DataFrame]


def run_stage(stage: Stage, inputs: list[DataFrame], completions: Completions, path: str) -> Outcome:
    """One stage from its inputs to its folder; a folder that is complete is read, not made again.

    ``completions(name, requests)`` is the table of what models answered, ``(request_id, seq, generation,
    prompt_tokens, completion_tokens)``, for the stage's requests."""
    requests = stage.requests(*inputs)
    rows = outcomes(requests, completions(stage.name, requests), stage.parse)
    if is_complete(rows.sparkSession, path):
        return read_split(rows.sparkSession, path, rows.schema)
    return write_split(rows, path, stage.name, stage.metrics)


def run(target: str, tables: dict[str, DataFrame], completions: Completions, out_dir: str,
        registry: dict[str, Stage] = REGISTRY) -> dict[str, Outcome]:
    """All stages ``target`` needs, in order; each stage's outcome by name."""
    done: dict[str, Outcome] = {}
    for stage in resolve(target, set(tables), registry):
        inputs = [tables[n] if n in tables else done[n].accepted for n in stage.needs]
        done[stage.name] = run_stage(stage, inputs, completions, f"{out_dir.rstrip('/')}/{stage.name}")
    return done


def run_rounds(stage_of: Callable[[int], Stage], state: DataFrame, completions: Completions, out_dir: str,
               rounds: int) -> list[Outcome]:
    """Rounds 1..n of an iterated stage: round r's input is what round r-1 accepted. Ends early with a round that
    has no requests. A broken-off run goes on with the first round that has no report."""
    done: list[Outcome] = []
    for r in range(1, rounds + 1):
        stage = stage_of(r)
        got = run_stage(stage, [state], completions, f"{out_dir.rstrip('/')}/{stage.name}")
        done.append(got)
        if got.report.filter((F.col("metric") == "total") & (F.col("value") == 0)).count():
            break
        state = got.accepted
    return done


# ---- C8: session n from session n-1 ---------------------------------------------------------

SESSION_STATE = ("unique_id", "name", "age", "gender", "birthplace", "residence", "events", "album")


def session_round_requests(state: DataFrame, n: int) -> DataFrame:
    """Requests of session ``n`` for every graph with at least ``n`` events (F5). ``events`` is the graph's array of
    ``{event, date, time_interval, experience}``, ``album`` the descriptions on the device so far: both are
    bounded by the graph, so history (W3) and the previous date (W4) are slices of them, not windows."""
    from curatio.functions.draws import stable_id
    from curatio.plans.events import eligible, session_requests
    graphs = eligible(state.withColumn("n_events", F.size("events")), n).drop("n_events")
    event = F.get("events", F.lit(n - 1))
    lines = F.transform(F.slice("events", 1, max(n - 1, 1)), lambda e: F.concat(F.lit("- "), e["date"], F.lit(": "), e["event"]))
    images = F.transform("album", lambda d, i: F.concat(i.cast("string"), F.lit(". "), d))
    rows = graphs.select(
        *SESSION_STATE, F.lit(n).cast("bigint").alias("session_number"), event["event"].alias("event"), event["date"].alias("date"),
        event["time_interval"].alias("time_interval"), event["experience"].alias("experience"),
        (F.get("events", F.lit(n - 2))["date"] if n > 1 else F.lit(None).cast("string")).alias("last_date"),
        (F.array_join(lines, "\n") if n > 1 else F.lit("")).alias("history_before"), F.array_join(images, "; ").alias("mobile_device"))
    return session_requests(rows).withColumn("request_id", stable_id("unique_id", "session_number"))


def session_round_parse(rows: DataFrame) -> DataFrame:
    """C8 parse of one round; an accepted session's album goes on with its new images appended."""
    from curatio.plans.dialogue import dialogue_parse, new_album_images
    from curatio.plans.episodes import extend_album
    parsed = dialogue_parse(rows).annotated.withColumn("reject_reason", F.when(F.col("verdict") != "ok", F.col("verdict")))
    grown = extend_album(F.col("album"), F.coalesce(new_album_images(F.col("utterances")), F.array().cast("array<string>")))
    return parsed.withColumn("album_before", F.size("album").cast("bigint")) \
        .withColumn("album", F.when(F.col("reject_reason").isNull(), grown).otherwise(F.col("album"))).drop("verdict", "shape", "n_items")


SESSION_METRICS = {"dialogue_syntax:fail": "reject_reason = 'syntax:fail'", "dialogue_parse:fail": "reject_reason = 'parse:fail'",
                   "dialogue_key_existence:fail": "reject_reason = 'key:fail'", "dialogue:total": f"outcome <> '{PENDING}'"}


def session_round(n: int) -> Stage:
    return Stage(f"session_{n}", ("session_state",), lambda state: session_round_requests(state, n), session_round_parse, SESSION_METRICS)


# ---- the library's stages -------------------------------------------------------------------

def _persona_parse(rows: DataFrame) -> DataFrame:
    from curatio.plans.persona import normalise_entity_key, parse_pieces, explode_list
    pieces = parse_pieces(explode_list(rows, "generation", 30))
    exact = (F.lower("key") == normalise_entity_key("persona_entity_key")) & F.lower("sent").contains(F.lower("value"))
    reason = F.when(~F.col("matched"), "regex:discard").when(~F.coalesce(exact, F.lit(False)), "exact:discard")
    return pieces.withColumn("reject_reason", reason).drop("matched")


def _event_requests(personas: DataFrame) -> DataFrame:
    """One graph per accepted sentence, first wins (A2): its request continues the sentence as the first event."""
    from curatio.functions.draws import stable_id
    from curatio.plans.events import event_requests
    first = dedupe_first(personas.select("sent", "name", "persona_seed", "request_id", "piece_idx"), ["sent"], ["request_id", "piece_idx"])
    named = first.select("sent", "name", "persona_seed", F.col("sent").alias("narrative"), stable_id("sent").alias("request_id"))
    return event_requests(named)


def _event_parse(rows: DataFrame) -> DataFrame:
    from curatio.plans.events import event_parse
    return event_parse(rows).annotated


def _state_requests(graphs: DataFrame, people: DataFrame) -> DataFrame:
    """C8's first input: every accepted graph with its person's profile and an empty device."""
    edge = lambda m: F.from_json(m["caused_by"], "map<string,string>")
    events = F.transform("nodes", lambda m: F.struct(
        m["event"].alias("event"), m["date"].alias("date"), edge(m)["caused_by:time_interval"].alias("time_interval"),
        edge(m)["caused_by:experience"].alias("experience")))
    state = graphs.join(people, "name").select(F.concat_ws(":", "persona_seed", "request_id").alias("unique_id"), "name", "age", "gender",
                                               "birthplace", "residence", events.alias("events"), F.array().cast("array<string>").alias("album"))
    return session_round_requests(state, 1)


def _reasons(*names: str) -> dict[str, str]:
    return {n: f"reject_reason = '{n}'" for n in names}


PERSONA = register(Stage("persona", ("persona_requests",), lambda requests: requests, _persona_parse, _reasons("regex:discard", "exact:discard")))
EVENT = register(Stage("event", ("persona",), _event_requests, _event_parse, _reasons("syntax:fail", "not_a_list", "key:fail")))
SESSION = register(Stage("session_1", ("event", "people"), _state_requests, session_round_parse, SESSION_METRICS))
