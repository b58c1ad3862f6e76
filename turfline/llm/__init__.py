"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this subpackage imports it. The operators take a DataFrame and
column names, read only those columns (extra columns never clash with internal
names, which start with ``_``), and return a DataFrame.
"""
