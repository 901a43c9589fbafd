"""Operators for building training corpora.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Each module holds one operator with a general interface, and
:mod:`tidewell.llm.queries` binds the operators to the standard tables.
"""
