"""Whole jobs: the daily load, silver, gold and the marts."""
