"""Interval, sequence and annotation analytics as DataFrame-to-DataFrame operators."""
