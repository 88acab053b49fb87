"""Structured Streaming entry points for the stateless operators."""

from textflow.streaming.incidents import (  # noqa: F401
    stream_incident_features, stream_reports, write_stream,
)
