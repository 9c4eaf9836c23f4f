"""Document-layout analytics over page records, in DataFrames.

functions: column expressions.  operators: DataFrame to DataFrame.  sources and
streaming: what comes in.  plans: whole queries.
"""
