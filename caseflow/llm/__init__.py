"""Operators for building training data from large corpora.

Each module holds one operator with a general interface; ``queries`` applies them to the
tables of a folder and ``oracle`` has SQL for those that SQL can express. Nothing outside
this package imports it.
"""
