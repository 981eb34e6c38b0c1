"""Scalar Column -> Column functions; all are native Spark expressions."""

from .text import strip_nul, squash_ws, truncate_tokens, non_empty, words, WHITESPACE_RUN, WORD_RUN, TOKEN_RUNS
from .paths import object_path, optimized_object_path, optimized_path, parent_folder, path_ancestors
from .fields import (
    obfuscate_email, is_ready, public_tag, page_doc_id, relative_index, readable_by,
    fill_to_page, in_page_range, needs_embedding, path_changed, is_file, notifiable, is_pdf,
)

__all__ = [
    "strip_nul", "squash_ws", "truncate_tokens", "non_empty", "words", "WHITESPACE_RUN", "WORD_RUN", "TOKEN_RUNS",
    "object_path", "optimized_object_path", "optimized_path", "parent_folder", "path_ancestors",
    "obfuscate_email", "is_ready", "public_tag", "page_doc_id", "relative_index", "readable_by",
    "fill_to_page", "in_page_range", "needs_embedding", "path_changed", "is_file", "notifiable", "is_pdf",
]
