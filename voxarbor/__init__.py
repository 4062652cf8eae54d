"""voxarbor: sparse-volume and tree analytics on Spark DataFrames."""
