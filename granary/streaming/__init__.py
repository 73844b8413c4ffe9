"""streaming of granary."""
