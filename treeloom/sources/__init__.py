"""sources of the tree engine."""
