"""Where sequences come from."""
