"""Container analytics on Spark: sources, search, matching, integrity and rewriting as DataFrame operators."""
