"""The fixed tables of a store."""

from __future__ import annotations

TABLES = {
    "documents": "id bigint, path string, adapter string, content_hash string, ingested_at bigint",
    "entities": "id string, entity_type string",
    "facts": "id bigint, subject string, predicate string, object_json string, document_id bigint, adapter string, confidence double, observed_at bigint, locator string",
    "section_cache": "section_hash string, extracted_at bigint, fact_count bigint",
    "conflicts": "id bigint, subject string, predicate string, fact_a_id bigint, fact_b_id bigint, resolved_at bigint, resolution string",
    "predicate_cardinality": "predicate string, entity_type string, cardinality string, confidence double, decided_by string, decided_at bigint",
    "entity_aliases": "entity_id string, alias string, alias_norm string, source string, confidence double",
    "entity_embeddings": "entity_id string, embedding array<float>, model string, card_hash string, created_at bigint",
    "section_embeddings": "section_hash string, embedding array<float>, model string, created_at bigint",
    "resolution_blocklist": "alias_norm string, entity_id string, blocked_at bigint",
}

#: Keys by which rows of a table replace one another.
KEYS = {
    "documents": ["path", "content_hash"], "entities": ["id"], "facts": ["id"], "section_cache": ["section_hash"], "conflicts": ["id"],
    "predicate_cardinality": ["predicate", "entity_type"], "entity_aliases": ["entity_id", "alias_norm"], "entity_embeddings": ["entity_id"],
    "section_embeddings": ["section_hash", "model"], "resolution_blocklist": ["alias_norm", "entity_id"],
}
