"""operators of the tree engine."""
