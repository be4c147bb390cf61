"""sources of quillgraph."""
