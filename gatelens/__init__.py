"""Gateway traffic analytics on Spark: reports over request logs, event logs and recorded response chunks."""

__version__ = "0.1.0"
