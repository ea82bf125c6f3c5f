"""End-to-end preparation, linkage and reporting flows."""
