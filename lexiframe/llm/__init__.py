"""Operators for preparing text corpora: one module per operator, each with its ``op*`` query."""
