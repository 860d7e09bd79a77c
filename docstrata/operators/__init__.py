"""operators of docstrata."""
