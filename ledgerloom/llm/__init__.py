"""Operators for building large text training sets, and the registered queries that apply them.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
