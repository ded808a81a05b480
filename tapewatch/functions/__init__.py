"""Functions of the tick analytics library."""
