"""Operators of a training-data pipeline: deduplication, scans, quality, mixing and tokens.

Nothing else in the library imports this subpackage. Conventions shared by all operators:

- a null text is an empty text; a null id, source or url is a value like any other;
- extra columns are carried by nothing but the pipeline stages, which keep them as they are, whatever their names;
- rows that repeat another row in full are documents of their own and get the same result;
- an empty table gives an empty result with the full schema.
"""
