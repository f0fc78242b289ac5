"""How ordered computations are laid out over partitions."""
