"""Sequence-signature classification and table operators on Spark."""
