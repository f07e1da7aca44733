"""factorlake: factor research on long OHLCV panels, expressed as Spark plans."""
