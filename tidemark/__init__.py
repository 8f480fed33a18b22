"""Market-signal analytics as declarative Spark plans."""
