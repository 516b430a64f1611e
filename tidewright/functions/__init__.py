"""Column-level helpers: text cleaning, null-safe arithmetic, calendar ticks."""
