"""quarry: a Spark-native engine for building and querying text corpora and chat data.

Every operator takes DataFrames and returns DataFrames. Work stays in Spark SQL
expressions and windows wherever the logic allows; the few sequential steps run as
Arrow-batched grouped functions on executors.
"""

__version__ = "0.1.0"
