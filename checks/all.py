"""Importing this registers every query."""

from checks import analysis, catalogue, expressions, files, history, imports, rules, shelves  # noqa: F401
