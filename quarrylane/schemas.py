"""Schemas of the engine's tables, the sources that share them, and their partitioning."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
    "decimal(12,6)": T.DecimalType(12, 6),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(columns: str) -> T.StructType:
    """A schema from ``name type [not null]`` entries; needs no session."""
    parts = [c.split(" ", 2) for c in columns.split(", ")]
    return T.StructType([T.StructField(p[0], _TYPES[p[1]], len(p) < 3) for p in parts])


# Table layouts.
CHUNKS = _schema(
    "source_type string not null, fiscal_year string not null, quarter string not null, bank string not null, filename string not null, file_id string not null, "
    "file_type string not null, file_path string not null, file_hash string not null, page_number int, name string, summary string, chunk_id string not null, chunk_content string, "
    "keywords array<string>, metrics array<string>, keyword_embedding array<float>, metric_embedding array<float>, summary_embedding array<float>, chunk_embedding array<float>, created_at timestamp"
)
EMBEDDINGS = _schema(
    "embedding_id string not null, embedding_type string not null, embedding_scope string not null, source_type string not null, fiscal_year string not null, quarter string not null, "
    "bank string not null, filename string not null, file_id string not null, file_type string not null, file_path string not null, file_hash string not null, content_unit_id string, "
    "content_unit_ids array<string>, chunk_id string, section_id string, embedding_text string not null, text_hash string, embedding array<float>, embedding_model string not null, "
    "embedding_dimensions int not null, created_at timestamp not null"
)
AVAILABILITY = _schema(
    "id int not null, bank_id int not null, bank_name string not null, bank_symbol string not null, bank_aliases array<string>, bank_tags array<string>, fiscal_year int not null, "
    "quarter string not null, database_names array<string>, last_updated timestamp, last_updated_by string"
)
PROMPTS = _schema(
    "id int not null, model string not null, layer string not null, name string not null, description string, comments string, system_prompt string, user_prompt string, "
    "tool_definition string, uses_global array<string>, version string not null, created_at timestamp, updated_at timestamp"
)
MONITOR = _schema(
    "log_id bigint not null, run_uuid string not null, model_name string not null, stage_name string not null, stage_start_time timestamp not null, stage_end_time timestamp, duration_ms int, "
    "llm_calls string, total_tokens int, total_cost decimal(12,6), status string, decision_details string, error_message string, log_timestamp timestamp, user_id string, environment string, "
    "custom_metadata string, notes string"
)
TABLES = {"chunks": CHUNKS, "embeddings_long": EMBEDDINGS, "availability": AVAILABILITY, "prompts": PROMPTS, "monitor": MONITOR}
#: All sources share the chunk and embedding tables; a source is a partition.
PARTITIONS = {"chunks": ["source_type", "fiscal_year", "quarter"], "embeddings_long": ["source_type", "fiscal_year", "quarter"]}
KEYS = {"chunks": ["file_id", "chunk_id"], "embeddings_long": ["embedding_id"], "availability": ["bank_id", "fiscal_year", "quarter"], "prompts": ["model", "layer", "name", "version"], "monitor": ["log_id"]}
EMBEDDING_TYPES = ("content", "keyword", "metric", "section_summary", "document_summary")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
