"""Operators over DataFrames: batch and patch reads, events, sampling, planning."""
