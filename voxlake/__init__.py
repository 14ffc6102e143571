"""voxlake: volumetric analytics on Spark - chunked grids, point clouds, graphs and label catalogs as DataFrames."""
