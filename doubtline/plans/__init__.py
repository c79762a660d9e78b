"""Whole plans: monitors, adjudicators, experiments and batch jobs."""
