"""crateflow — collection analytics (catalogue, derivations, artist graph) on Spark.

Every operator is a function DataFrame(s) -> DataFrame. Nothing is collected
to the driver except scalar loop-termination counts in the iterative graph jobs.
"""

__version__ = "0.1.0"
