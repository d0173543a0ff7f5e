"""The tables of a store."""

from __future__ import annotations

MEMORIES = (
    "id bigint, content string, masked_content string, reformulated string, source string, modality string, sensitivity string, category string,"
    " created_at timestamp, last_echoed timestamp, echo_count int, enriched boolean, enrichment_attempts int, confidence float, subject string,"
    " parent_id bigint, labels array<string>, label_version int, triples array<struct<subject:string,predicate:string,object:string>>,"
    " novelty_score double, importance double, importance_computed_at timestamp, superseded_at timestamp, entity_id string"
)
VECTORS = "id bigint, modality string, v array<float>"
EDGES = "src bigint, dst bigint, weight double, activation_count bigint, last_activated double, kind string, value string, valid_from double, valid_until double"
ENTITIES = "entity_id string, canonical_name string, aliases array<string>, kind string, attributes map<string,string>, created_at timestamp, updated_at timestamp"
SUMMARIES = "label string, summary string, v array<float>, member_count bigint, updated_at timestamp"
TABLES = {"memories": MEMORIES, "vectors": VECTORS, "edges": EDGES, "entities": ENTITIES, "summaries": SUMMARIES}
#: What a column that an older snapshot lacks is filled with.
DEFAULTS = {"echo_count": 0, "enriched": False, "enrichment_attempts": 0, "confidence": 1.0, "modality": "text", "sensitivity": "Public", "category": "Default", "label_version": 0, "novelty_score": 0.0, "importance": 0.0}
