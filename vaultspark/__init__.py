"""An analytics engine for document vaults on Spark DataFrames."""
