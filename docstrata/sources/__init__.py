"""sources of docstrata."""
