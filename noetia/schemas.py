"""Data model: canonical schemas, enumerations, defaults, configuration and errors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
    "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Parsed here, as Spark's own parser needs a session."""
    return T.StructType([T.StructField(*(x.split(" ")[0], _TYPES[x.split(" ")[1]])) for x in columns.split(", ")])


NODES = _schema(
    "id STRING, memory_id STRING, user_id STRING, name STRING, entity_type STRING, description STRING, canonical_name STRING, aliases ARRAY<STRING>, properties STRING, embedding ARRAY<FLOAT>, importance INT, state STRING, created_at TIMESTAMP, updated_at TIMESTAMP, accessed_at TIMESTAMP, access_count BIGINT"
)
EDGES = _schema(
    "id STRING, memory_id STRING, source_id STRING, target_id STRING, relation_type STRING, description STRING, properties STRING, weight DOUBLE, confidence DOUBLE, importance INT, state STRING, created_at TIMESTAMP, updated_at TIMESTAMP, accessed_at TIMESTAMP, access_count BIGINT, valid_from TIMESTAMP, valid_until TIMESTAMP"
)
CLUSTERS = _schema(
    "id STRING, memory_id STRING, summary STRING, entities ARRAY<STRING>, edges ARRAY<STRING>, importance INT, coherence_score DOUBLE, density DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP, metadata STRING"
)
MEMORIES = _schema(
    "id STRING, name STRING, description STRING, metadata STRING, importance INT, state STRING, created_at TIMESTAMP, updated_at TIMESTAMP, version INT, parent_id STRING"
)
EVENTS_LOG = _schema(
    "id STRING, evolution_type STRING, memory_id STRING, affected_nodes ARRAY<STRING>, affected_edges ARRAY<STRING>, before_state STRING, after_state STRING, reason STRING, metadata STRING, ts TIMESTAMP, success BOOLEAN"
)
CHUNKS = _schema(
    "id STRING, source_id STRING, chunk_index INT, start_char INT, end_char INT, content STRING, modality STRING, metadata MAP<STRING,STRING>, summary STRING, entities ARRAY<STRING>, key_phrases ARRAY<STRING>"
)

# Importance levels and their labels, states, event types, modalities, context priorities
IMPORTANCE = {"EPHEMERAL": 0, "VERY_LOW": 1, "LOW": 3, "MEDIUM": 5, "HIGH": 6, "VERY_HIGH": 8, "CRITICAL": 10}
#: Least score of each level, highest first.
IMPORTANCE_STEPS = ((9.0, 10), (7.0, 8), (5.5, 6), (4.0, 5), (2.0, 3), (0.5, 1))
STATES = ("ACTIVE", "CONSOLIDATING", "DECAYING", "ARCHIVED", "DELETED")
EVOLUTION_TYPES = ("CONSOLIDATION", "DECAY", "REINFORCEMENT", "SYNTHESIS", "PRUNING", "REHYDRATION", "CORRECTION")
MODALITIES = ("text", "markdown", "pdf", "image", "audio", "webpage", "code", "json", "csv")
CONTEXT_PRIORITIES = ("balanced", "entities", "relationships", "communities", "documents")


@dataclass
class EngineConfig:
    """Settings with environment overrides ``NOETIA_<NAME>``; values that can't be parsed keep the default."""

    top_k: int = 10
    min_similarity: float = 0.5
    min_importance: int = 1
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    kg_chunk_size: int = 2048
    kg_chunk_overlap: int = 200
    consolidation_threshold: float = 0.85
    decay_half_life_days: float = 30.0
    decay_enabled: bool = True
    evolve_interval_seconds: int = 3600
    rehydration_threshold: float = 0.75
    rehydration_limit: int = 100
    token_limit: int = 8000
    tokens_per_byte: float = 0.25
    max_cluster_size: int = 100
    min_cluster_size: int = 2
    embedding_dim: int = 64
    cache_ttl_seconds: int = 3600
    auto_evolve: bool = False
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        cfg = cls()
        for f in fields(cls):
            raw = env.get(f"NOETIA_{f.name.upper()}")
            if raw is None or f.name == "extra":
                continue
            now = getattr(cfg, f.name)
            try:
                value = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(now, bool) else type(now)(raw)
            except ValueError:
                continue
            setattr(cfg, f.name, value)
        return cfg


class NoetiaError(Exception):
    """Base error with a code, a context, and whether a retry may help."""

    code, recoverable = "ERROR", False

    def __init__(self, message: str, cause: Exception | None = None, suggestions: tuple[str, ...] = (), **context):
        super().__init__(message)
        self.context, self.cause, self.suggestions = context, cause, suggestions

    def __str__(self):
        return f"[{self.code}] {super().__str__()}" + (f" (cause: {self.cause})" if self.cause else "")


def _error(name: str, code: str, recoverable: bool = False):
    return type(name, (NoetiaError,), {"code": code, "recoverable": recoverable})


ConfigurationError = _error("ConfigurationError", "CONFIG")
StorageError = _error("StorageError", "STORAGE")
IngestionError = _error("IngestionError", "INGESTION")
QueryError = _error("QueryError", "QUERY")
EvolutionError = _error("EvolutionError", "EVOLUTION")
ExtractionError = _error("ExtractionError", "EXTRACTION")
EmbeddingError = _error("EmbeddingError", "EMBEDDING")
RateLimitError = _error("RateLimitError", "RATE_LIMIT", True)
OperationTimeoutError = _error("OperationTimeoutError", "TIMEOUT", True)
