"""Descriptive statistics, correlation, hypothesis tests."""
