"""Registered queries: each operator applied to the given tables, with its SQL check beside it."""
