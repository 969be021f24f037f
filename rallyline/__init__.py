"""Analytics over ordered event streams, as Spark plans."""
