"""End-to-end compositions and the named query catalog."""
