"""Column functions: text (JVM expressions) and fuzzy (an Arrow UDF)."""
