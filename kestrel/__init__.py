"""kestrel: a Spark-first analytics engine for multi-source player/entity valuation work."""
