"""shardloom: a Spark-native engine for keyed, sharded tables."""

__version__ = "0.1.0"
