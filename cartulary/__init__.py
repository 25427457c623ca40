"""Analytics over collections of semi-structured records, as DataFrames."""
