"""Spark operators for tables of ratings: who labelled what, and how they differ."""
