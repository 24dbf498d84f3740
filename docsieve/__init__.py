"""Sensitive-document analytics as Spark jobs: span detection, joins, scoring, policy and rewriting."""
