"""Table layouts. Each kind of row has its own table, so retrieval never meets marker rows."""

from __future__ import annotations

CHUNKS = """
    id STRING, message_id STRING, workspace_id STRING, session_id STRING, role STRING,
    document STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP, chunk_index INT,
    total_chunks INT, content_hash STRING, scope STRING, peer_id STRING,
    peer_ids ARRAY<STRING>, source_type STRING, source_path STRING, header_path STRING,
    chunk_type STRING, tags ARRAY<STRING>, importance DOUBLE, agent STRING,
    language STRING, parent_doc_id STRING, doc_title STRING, vault_chunk_id STRING,
    file_hash STRING, entities ARRAY<STRING>, summary_1line STRING,
    extra MAP<STRING,STRING>
"""
SESSIONS = """
    workspace_id STRING, session_id STRING, peer_ids ARRAY<STRING>, scope STRING,
    created_at TIMESTAMP
"""
CONCLUSIONS = """
    id STRING, workspace_id STRING, peer_id STRING, document STRING,
    embedding ARRAY<FLOAT>, created_at TIMESTAMP, source STRING, session_id STRING
"""
REASONING = """
    id STRING, workspace_id STRING, peer_id STRING, conclusion_id STRING,
    premise_ids ARRAY<STRING>, supporting_message_ids ARRAY<STRING>, created_at TIMESTAMP
"""
CODE_EDGES = "id STRING, workspace_id STRING, src STRING, rel STRING, dst STRING, file STRING"
PEERS = "workspace_id STRING, peer_name STRING, created_at TIMESTAMP, extra MAP<STRING,STRING>"
PEER_CARDS = """
    workspace_id STRING, peer_id STRING, lines ARRAY<STRING>, embedding ARRAY<FLOAT>,
    updated_at TIMESTAMP
"""
SCOPES = "workspace_id STRING, scope_name STRING, sessions ARRAY<STRING>, created_at TIMESTAMP"
WORKSPACES = "workspace_id STRING, name STRING, created_at TIMESTAMP, extra MAP<STRING,STRING>"
USAGE = "ts TIMESTAMP, action STRING, source STRING, agent STRING, workspace STRING"
PENDING = """
    message_id STRING, workspace_id STRING, content STRING, sections MAP<STRING,STRING>,
    session_id STRING, role STRING, metadata MAP<STRING,STRING>, requester STRING,
    queued_at TIMESTAMP, status STRING, attempts INT, last_error STRING,
    applied_at TIMESTAMP
"""
MESSAGES_IN = """
    message_id STRING, workspace_id STRING, session_id STRING, role STRING, content STRING,
    scope STRING, peer_id STRING, metadata MAP<STRING,STRING>, created_at TIMESTAMP
"""
API_KEYS = "id STRING, workspace_id STRING, prefix STRING, created_at TIMESTAMP"
WEBHOOKS = "workspace_id STRING, url STRING, events ARRAY<STRING>"
TEXT_DOCS = "workspace_id STRING, id STRING, entry BIGINT, words INT"
CODE_FILES = ("workspace_id STRING, path STRING, file_hash STRING, imports ARRAY<STRING>, "
              "symbols ARRAY<STRUCT<name: STRING, tokens: ARRAY<STRING>>>")
TEXT_GRAMS = "workspace_id STRING, entry BIGINT, gram STRING"
GRAPH_NODES = "id STRING, type STRING, label STRING"
GRAPH_EDGES = "from STRING, to STRING, relation STRING, weight DOUBLE"

TABLES = {
    "chunks": CHUNKS, "sessions": SESSIONS, "conclusions": CONCLUSIONS,
    "reasoning": REASONING, "code_edges": CODE_EDGES, "peers": PEERS,
    "peer_cards": PEER_CARDS, "scopes": SCOPES, "workspaces": WORKSPACES, "usage": USAGE,
    "pending": PENDING, "api_keys": API_KEYS, "webhooks": WEBHOOKS,
    "text_docs": TEXT_DOCS, "text_grams": TEXT_GRAMS, "code_files": CODE_FILES,
}
# The columns that identify one row of each table. Ids are unique inside a workspace only.
KEYS = {
    "chunks": ["workspace_id", "id"], "sessions": ["workspace_id", "session_id"],
    "conclusions": ["workspace_id", "id"], "reasoning": ["workspace_id", "id"],
    "code_edges": ["workspace_id", "id"], "peers": ["workspace_id", "peer_name"],
    "peer_cards": ["workspace_id", "peer_id"], "scopes": ["workspace_id", "scope_name"],
    "workspaces": ["workspace_id"], "pending": ["workspace_id", "message_id"], "api_keys": ["id"],
    "webhooks": ["workspace_id", "url"], "code_files": ["workspace_id", "path"], "text_docs": ["workspace_id", "id"], "text_grams": ["workspace_id", "entry", "gram"],
}
