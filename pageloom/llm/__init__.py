"""Operators for preparing training text: one module per operator, its query and, where SQL can say it, its SQL twin.

Nothing outside this package imports it.
"""
