"""Column builders. Everything here is lazy and row-local: no action, no shuffle."""
