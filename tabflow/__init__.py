"""tabflow: tabular profiling, cleaning and model training on Spark DataFrames.

Every operator takes and returns Spark ``DataFrame`` objects.  Statistics that
parameterise a later step (means, quantiles, scaling factors) are fitted with a
single fused aggregate, the way Spark ML estimators fit, and re-enter the plan
as literals; the data itself never leaves the executors.
"""

__version__ = "0.1.0"
