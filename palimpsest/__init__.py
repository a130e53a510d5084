"""Analytics over noisy, semi-structured document text, declared as Spark plans."""
