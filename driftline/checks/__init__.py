"""Registered queries and their SQL twins, by area."""
