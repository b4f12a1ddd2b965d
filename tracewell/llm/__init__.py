"""Operators for preparing training text at scale.

One module per operator; ``queries`` registers their queries. Nothing
else in the library imports this subpackage.
"""
