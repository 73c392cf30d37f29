"""Registered queries of the core and their SQL."""
