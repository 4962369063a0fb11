"""One module for each group of movement operators; all take and return DataFrames."""
