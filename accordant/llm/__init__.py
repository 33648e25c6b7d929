"""Operators for preparing training text, each written for tables of any size.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries and their SQL; the other modules hold the operators.
"""
