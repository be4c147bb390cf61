"""streaming of quillgraph."""
