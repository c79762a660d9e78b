"""Relational operators: cleaning, sampling, statistics, neighbours, models, metrics."""
