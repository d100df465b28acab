"""Column -> Column functions. Everything here stays inside the JVM; there is no Python UDF."""
