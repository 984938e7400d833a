"""A full-text search and crawl-analytics engine on Spark DataFrames."""
