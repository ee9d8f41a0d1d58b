"""Column-level semantics: typed values, text analysis, time."""
