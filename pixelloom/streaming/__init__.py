"""Bounded ingestion of byte chunks."""
from .ingest import ByteRing, chunk_stream, chunk_total, pipe_chunks, ring_total  # noqa: F401
