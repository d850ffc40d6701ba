"""Registered queries over the standard tables, each with SQL of the same meaning."""
