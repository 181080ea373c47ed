"""Whole-corpus jobs: verdicts, profiles, statistics, lists under review."""
