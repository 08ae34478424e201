"""streaming of the tree engine."""
