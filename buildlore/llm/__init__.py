"""Operators of a training-data pipeline, one module each, with their queries beside them."""

from importlib import import_module

from buildlore.llm.base import ORACLES, QUERIES

MODULES = [
    "ngram_join", "url_filter", "chat_format", "embedding_dups", "paragraph_dedup", "byte_bpe", "quality", "decontamination", "language",
    "html_text", "whitening", "suffix_dedup", "token_alignment",
]


def load() -> tuple[dict, dict]:
    for module in MODULES:
        import_module(f"buildlore.llm.{module}")
    return QUERIES, ORACLES
