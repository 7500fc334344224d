"""DataFrame operators. Each takes and returns DataFrames and names its shuffle keys."""
