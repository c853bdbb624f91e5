"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own
general interface; :mod:`vicinity.llm.queries` derives the registered queries from them.
"""
