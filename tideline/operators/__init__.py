"""Operators over logs: pure functions from DataFrames to DataFrames.

Times are epoch milliseconds; what depends on the time takes ``now_ms``.
"""
