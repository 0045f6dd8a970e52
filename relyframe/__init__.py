"""relyframe: feature-reliance analytics on Spark DataFrames.

Cleaning, fit-on-train preprocessing, exact seeded splits, association
matrices, mutual information, feature clustering, model benchmarks and
model class reliance, all expressed as Spark DataFrame / Spark ML work.
"""

from relyframe.session import get_spark, scratch_path, checkpoint_dir

__all__ = ["get_spark", "scratch_path", "checkpoint_dir"]
