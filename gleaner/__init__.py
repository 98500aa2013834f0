"""gleaner: mines, matches, ranks and formats feedback text and media metadata with Spark DataFrames."""
