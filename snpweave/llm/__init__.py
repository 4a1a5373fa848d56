"""Operators of a training-data pipeline: language, toxicity, leaks, secrets, quality, duplicates, URLs, licences, packing.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`queries` applies the ten operators to
the shared tables with production parameters, and :mod:`oracles` has the SQL
that states the same results where SQL can.
"""
