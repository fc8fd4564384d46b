"""Sources of events: tables, JSON, and a length-framed binary protocol over TCP and UDP."""

from tidemark.sources.files import json_events, json_stream, parquet_stream  # noqa: F401
