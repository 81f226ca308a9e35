"""Analytics over conversations and text collections, expressed for Spark."""
