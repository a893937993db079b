"""Registered queries: each operator applied to volumes derived from the driver's tables, with its SQL."""
