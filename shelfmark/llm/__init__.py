"""Operators for training text: each module is one operator, ``queries`` applies them to the tables."""
