"""functions of granary."""
