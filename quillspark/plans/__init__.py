"""Composite plans: evidence bundles, report renderers and the query registry."""
