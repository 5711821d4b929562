"""Column expressions. JVM built-ins wherever Spark has one; Arrow UDFs elsewhere."""
