"""Operators for preparing training text at corpus scale.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the shared tables.  Nothing
outside this subpackage imports it.
"""
