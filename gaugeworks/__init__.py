"""Analytics over model-usage telemetry, and training-data operators, on PySpark."""
