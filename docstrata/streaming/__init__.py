"""streaming of docstrata."""
