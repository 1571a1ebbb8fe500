"""Site-audit, retrieval and search-analytics operators expressed on Spark DataFrames."""
