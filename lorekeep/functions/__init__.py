"""Column expressions that stay inside the JVM, and small Arrow UDFs."""
