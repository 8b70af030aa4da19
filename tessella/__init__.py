"""Analytics of labelled rasters and of the scores computed from them, as Spark plans."""
