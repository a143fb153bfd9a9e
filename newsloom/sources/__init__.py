"""Table sources, feed parsing and fixed catalogue values."""
