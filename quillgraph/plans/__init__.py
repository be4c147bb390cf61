"""plans of quillgraph."""
