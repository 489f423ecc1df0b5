"""Column functions (JVM-side) and the parser-side functions behind the Arrow operators."""
