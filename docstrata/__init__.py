"""docstrata: document structure (blocks, titles, outlines, ranked
sections) computed as Spark DataFrame jobs keyed by document."""

__version__ = "0.1.0"
