"""Operators by family; importing this registers their queries."""

from threadlake.operators import compaction, extract, facts, graph, ingest, metrics, profiles, recall, search, sets, targeted, transcripts, typos

__all__ = ["compaction", "extract", "facts", "graph", "ingest", "metrics", "profiles", "recall", "search", "sets", "targeted", "transcripts", "typos"]
