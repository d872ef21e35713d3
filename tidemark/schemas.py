"""Tables of the file-history model, value lists and limits."""

from __future__ import annotations

#: Columns of each table, as DDL.
SCHEMA_MIGRATIONS = "version int, name string, applied_at long"
PATH_COMPONENTS = "id long, name string"
FILES = "id long, parent_id long, component_id long, is_dir boolean, size_bytes long, mtime_unix long, content_hash binary, deleted_at long"
EVENTS = "id long, file_id long, kind string, at_unix_ms long, size_bytes long, prev_parent_id long, prev_component_id long"
FILE_METADATA = (
    "file_id long, doc_type string, title string, author string, language string, page_count long, word_count long, image_taken_at_unix long,"
    " image_camera_model string, git_branch string, git_head_commit string, git_head_author string, git_head_at_unix long,"
    " extracted_at_unix long, extractor_version int, body_text string"
)
FILE_ENRICHMENT = "file_id long, summary string, keywords string, entities string, classification string, enriched_at_unix long, enrichment_version int"
QUEUE = "file_id long, queued_at_unix long, attempt_count int"
EMBEDDING_CONFIG = "id int, model string, dimensions int"
FILE_EMBEDDING = "file_id long, embedding array<float>, bits array<bigint>"

#: Kinds of events, document types and facet fields (fixed values).
EVENT_KINDS = ("created", "modified", "deleted", "renamed")
DOC_TYPES = ("text", "pdf", "jpeg", "tiff", "docx", "xlsx", "pptx", "unknown")
METADATA_FACETS = ("doc_type", "author", "language", "git_branch")
FACETS = (*METADATA_FACETS, "classification")
#: Directory names that scans and watches skip by default.
SKIP_DIRS = (".git", "node_modules", "target", ".cache", "__pycache__", ".venv")

#: Limits (fixed values).
DEFAULT_LIMIT, MAX_LIMIT = 50, 500
FACET_LIMIT = 50
MAX_ATTEMPTS = 5
QUEUE_BATCH = 16
HAMMING_OVERSAMPLE = 4
FILTER_OVERSAMPLE, MAX_CANDIDATES = 5, 500
MIN_ENRICH_CHARS = 300
MAX_BODY_CHARS = 8_000
MAX_READ_BYTES = 64 << 20
SNIFF_BYTES = 8_192
MAX_FACET_BYTES = 256
MAX_QUERY_BYTES = 4_096
DEBOUNCE_MS, RENAME_TTL_MS = 500, 1_000
LOG_DEFAULT, LOG_MAX = 200, 2_000
MAX_DEPTH = 256


def clamp(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    """A page size: the default if none is given, at least 1, at most ``most``."""
    return max(1, min(default if limit is None else limit, most))


def check_facet(field: str, value: str | None) -> None:
    """Refuse unknown facet fields and over-long values before planning."""
    if field not in FACETS:
        raise ValueError(f"unknown facet field: {field}")
    if value is not None and len(value.encode()) > MAX_FACET_BYTES:
        raise ValueError(f"{field} is longer than {MAX_FACET_BYTES} bytes")


def check_kind(kind: str | None) -> None:
    if kind is not None and kind not in EVENT_KINDS:
        raise ValueError(f"unknown event kind: {kind}")


def check_query(text: str) -> str:
    """A search text: not blank, at most 4,096 bytes."""
    if not text.strip():
        raise ValueError("the query is empty")
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise ValueError(f"the query is longer than {MAX_QUERY_BYTES} bytes")
    return text


def check_roots(roots: list[str]) -> list[str]:
    if not roots or any(not r.strip() for r in roots):
        raise ValueError("roots must not be empty")
    return roots
