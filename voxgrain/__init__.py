"""voxgrain: curate, profile and classify social posts with Spark DataFrames."""

__version__ = "0.1.0"
