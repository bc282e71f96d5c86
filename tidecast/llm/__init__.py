"""Operators of a large training-data pipeline.

Each module holds one operator with its own general interface;
``queries.py`` derives the registered ``opN_<name>`` queries from them.
Nothing outside this subpackage imports it.
"""
