"""Queries over the test tables, with the SQL that they are held against."""

from . import catalogue, further, search, streams, tables  # noqa: F401 - they add their queries to the catalogue
