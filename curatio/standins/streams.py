"""Streaming ingest query: the dialogue-validation generations are written as JSON
files (4 files) into a fresh folder under the shared checkpoint folder and ingested
one file per micro-batch; the accumulated output must equal the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.plans import dialogue as DG
from curatio.session import scratch_path
from curatio.sources.testdata import Tables
from curatio.standins.dialogue import VALIDATE_SQL, utterances, validated, validation_generations
from curatio.standins.registry import query
from curatio.streaming.ingest import ingest

SCHEMA = "unique_id string, session_number bigint, conv_id bigint, generation string"


def _parse(batch):
    return validated(DG.dialogue_parse(batch).annotated)


@query("stream_ingest_parse", VALIDATE_SQL)
def stream_ingest_parse(spark, sf_dir):
    base = scratch_path(spark, "ingest")
    gens = validation_generations(utterances(Tables(spark, sf_dir).conversations))
    gens.select("unique_id", "session_number", "conv_id", "generation") \
        .repartition(4, "unique_id").write.mode("overwrite").json(f"{base}/in")
    out = ingest(spark, f"{base}/in", SCHEMA, f"{base}/out", f"{base}/checkpoint", _parse)
    return out.drop("batch_id")


from curatio.plans.persona import persona_parse  # noqa: E402
from curatio.standins.persona import PIECES_SQL, persona_generations  # noqa: E402
from curatio.streaming.ingest import ingest_unique  # noqa: E402


def _accept(batch):
    r = persona_parse(batch)
    return r.exact.select("sent", "key", "value", "seq", "piece_idx")


@query("stream_persona_unique", f"""WITH {PIECES_SQL}
SELECT sent, key, value, seq, piece_idx FROM exact
QUALIFY row_number() OVER (PARTITION BY sent ORDER BY seq, piece_idx) = 1""")
def stream_persona_unique(spark, sf_dir):
    """Persona completions arrive as 4 files, one per micro-batch; a sentence is
    accepted once over all batches (first-wins by (seq, piece_idx))."""
    base = scratch_path(spark, "persona-ingest")
    gens = persona_generations(Tables(spark, sf_dir).part)
    gens.repartition(4, "seq").write.mode("overwrite").json(f"{base}/in")
    out = ingest_unique(spark, f"{base}/in", "seq bigint, generation string, persona_entity_key string",
                        f"{base}/out", f"{base}/checkpoint", _accept, ["sent"], ["seq", "piece_idx"],
                        max_files_per_trigger=1, buckets=8)
    return out.select("sent", "key", "value", "seq", F.col("piece_idx").cast("bigint").alias("piece_idx"))
