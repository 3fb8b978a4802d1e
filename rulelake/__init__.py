"""Rules over string-tuple facts and the analytics that feed them, as lazily evaluated Spark plans."""
