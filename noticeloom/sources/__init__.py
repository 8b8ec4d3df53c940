"""Readers of notice bundles and pages, and writers."""
