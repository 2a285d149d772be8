"""Column functions: each takes and returns Columns, so everything stays in the JVM."""
