"""Site-pattern analytics on Spark, with training-data operators in the optional ``llm`` subpackage."""
