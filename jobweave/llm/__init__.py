"""Operators for preparing training data, each in one module, and the queries that run them."""
