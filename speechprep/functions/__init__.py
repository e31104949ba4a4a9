"""Column-to-Column functions, and the helpers that run inside Python workers."""
