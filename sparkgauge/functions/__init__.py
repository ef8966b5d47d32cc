"""Column functions: rounding at fixed points, vocabularies and text measures."""
