"""Search, graph and write operators over DataFrames."""
