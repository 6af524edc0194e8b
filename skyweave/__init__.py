"""skyweave: probabilistic cross-matching of source catalogues on Spark."""
