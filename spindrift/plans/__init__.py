"""Fixture plans, registered queries and their SQL."""
