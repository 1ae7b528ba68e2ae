"""Whole plans: derived fixtures, the market snapshot, the summary."""
