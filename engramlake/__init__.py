"""engramlake: a Spark-native analytics engine for conversational memory."""

__version__ = "0.1.0"
