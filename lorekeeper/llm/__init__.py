"""Operators that prepare training text for language models.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL.
"""
