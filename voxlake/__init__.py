"""voxlake: sparse-voxel and corpus analytics expressed on Spark DataFrames."""
