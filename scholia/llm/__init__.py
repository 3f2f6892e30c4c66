"""Operations of a large training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` applies each one to its whole table.
"""
