"""Incremental forms of the batch operators, for tables that keep growing."""
