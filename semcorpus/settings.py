"""Tunables and closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

# File extensions per modality, and the source label each modality gets.
MODALITY_EXTENSIONS = {
    "pdf": [".pdf"],
    "images": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp"],
    "audio": [".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv"],
    "text": [".txt", ".log"],
    "markdown": [".md", ".markdown"],
    "json": [".json", ".jsonl"],
    "csv": [".csv", ".tsv"],
    "documents": [".doc", ".docx", ".odt", ".rtf"],
}
MODALITY_SOURCES = {
    "pdf": "pdf",
    "images": "screenshot",
    "audio": "recording",
    "video": "video",
    "text": "file",
    "markdown": "markdown",
    "json": "json",
    "csv": "csv",
    "documents": "document",
}
# Both spellings of a modality select the same rows in a filter.
MODALITY_ALIASES = {
    "images": "image",
    "image": "images",
    "documents": "document",
    "document": "documents",
}
# Registered media types of the extensions above.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".m4a": "audio/mp4",
    ".flac": "audio/flac",
    ".ogg": "audio/ogg",
    ".aac": "audio/aac",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".mov": "video/quicktime",
    ".mkv": "video/x-matroska",
    ".webm": "video/webm",
    ".flv": "video/x-flv",
    ".txt": "text/plain",
    ".log": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".json": "application/json",
    ".jsonl": "application/json",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".rtf": "application/rtf",
}


@dataclass(frozen=True)
class Settings:
    """Knobs that change what a job computes or how it is split."""

    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 10
    search_multiplier: int = 5
    pool_floor: int = 50
    # Lists of an index that a search reads unless told otherwise.
    probes: int = 8
    dim: int = 768
    # A side is shipped to every task only below this many bytes.
    broadcast_bytes: int = 64 << 20
    # Above this many vectors a pair search without centroids trains its own.
    pair_rows: int = 200_000
    # Rows on one side of a vector block; a task holds two blocks.
    block_rows: int = 4096

    def __post_init__(self) -> None:
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")


DEFAULTS = Settings()
