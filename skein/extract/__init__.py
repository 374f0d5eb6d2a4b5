"""Symbols, callees and imports out of source files: one parser per family of languages."""
