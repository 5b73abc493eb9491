"""Registered queries: operators wired to tables, each with its SQL counterpart where one exists."""
