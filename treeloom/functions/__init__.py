"""functions of the tree engine."""
