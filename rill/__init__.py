"""Record-stream analytics on Spark: ordered DataFrame operators, sources, expressions and streaming queries."""
