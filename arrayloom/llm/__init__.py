"""Training-data operators: each module is one operator; ``queries`` binds them to tables.

Nothing outside this subpackage imports it.
"""
