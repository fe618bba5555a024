"""riskloom - transaction-risk analytics expressed as Spark DataFrame transforms.

Every public operator is ``DataFrame -> DataFrame`` (or takes several
DataFrames and returns one).  Nothing is collected to the driver except
bounded scalars (a handful of quantile edges, model coefficients).
"""

__version__ = "0.1.0"
