"""plans of docstrata."""
