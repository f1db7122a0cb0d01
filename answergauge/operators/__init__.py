"""Scoring, correction, grouping, gates and reports."""
