"""Relational operators: ranking, fusion, suppression, alignment, profiling, intervals, references."""
