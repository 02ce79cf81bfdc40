"""Registered queries: each operator over the derived log, with equal SQL where SQL can say it."""
