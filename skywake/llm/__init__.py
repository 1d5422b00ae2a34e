"""Operators for preparing training data at scale, each a set of Spark jobs over whole tables."""
