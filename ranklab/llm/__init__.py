"""Operators for training-data pipelines: one module per operator, their
registered queries in ``ranklab.llm.catalog``. Nothing else in the library
imports this package."""
