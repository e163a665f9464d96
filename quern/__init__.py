"""quern: a Spark-native analytics engine for preparing and auditing training corpora."""

__version__ = "0.1.0"
