"""Analytics operators on DataFrames: tables, text, vectors, series, models, streams."""
