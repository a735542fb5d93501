"""Structured Streaming re-aims of the scheduled monitors (freshness and
correction scans) over events-shaped input."""
from plumbline.streaming.monitors import (  # noqa: F401
    run_freshness_stream, run_term_hits_stream)
