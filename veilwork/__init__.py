"""veilwork: data-privacy profiling, scanning, risk metrics and synthetic tables on Spark DataFrames."""
