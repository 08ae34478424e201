"""kernels of the tree engine."""
