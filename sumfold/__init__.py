"""sumfold: mergeable aggregation on Spark DataFrames.

Every aggregate is an algebraic structure with an identity and an associative
merge, so results built per partition, per day or per micro-batch can be
stored, merged and queried later.
"""

__version__ = "0.1.0"
