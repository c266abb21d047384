"""Extraction of definitions, calls, imports, routes and service calls from source text."""
