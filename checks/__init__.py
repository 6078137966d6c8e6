"""Registered queries, their derived input tables and their SQL oracles."""
