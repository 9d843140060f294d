"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface; ``queries`` binds them to the synthetic
tables.
"""
