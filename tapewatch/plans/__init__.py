"""Plans of the tick analytics library."""
