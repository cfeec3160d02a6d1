"""Picks, boards, matches, conditions, discovery and probes."""
