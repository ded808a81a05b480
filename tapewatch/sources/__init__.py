"""Sources of the tick analytics library."""
