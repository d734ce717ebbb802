"""streaming of quillmill."""
