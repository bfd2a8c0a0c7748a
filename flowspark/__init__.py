"""flowspark: flow and event-stream analytics as PySpark DataFrame plans."""
