"""Foliant: grounded-document analytics on Spark."""
