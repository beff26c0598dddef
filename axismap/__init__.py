"""axismap: pairwise coordinate maps between two axes of named sequences, on Spark."""
