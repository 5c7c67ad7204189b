"""Certified-abstention coding of text corpora on Spark."""
