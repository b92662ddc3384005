"""Operators for preparing training text: duplicates, mixing, scoring, tokens and licences."""
