"""The oldest calls: chunks of one text by size in characters. Bad sizes give no chunks instead of an error."""

from __future__ import annotations

from ..errors import LoomError
from ..functions.recursive import RecursiveConfig
from .splitting import Chunk, split

BROKEN = "legacy:v0|broken"


def chunk_document(text: str, max_size: int = 512, min_size: int = 0, overlap: int = 0) -> tuple[list[Chunk], str]:
    """The chunks of a text and the fingerprint of how they were made."""
    try:
        config = RecursiveConfig(max_size, min_size, overlap)
    except LoomError:
        return [], BROKEN
    return split(text, config), config.fingerprint


def chunk_text(text: str, max_size: int = 512) -> list[str]:
    """Only the texts of the chunks."""
    return [str(c["text"]) for c in chunk_document(text, max_size)[0]]
