"""Configuration-graph analytics, written as Spark DataFrame plans."""
