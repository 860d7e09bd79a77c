"""functions of docstrata."""
