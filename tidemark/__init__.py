"""Technical analysis over OHLCV bars, expressed as Spark plans."""
