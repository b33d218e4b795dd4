"""Operations of a training-data pipeline, each a function from DataFrames to DataFrames.

Nothing else in the library imports this subpackage.
"""
