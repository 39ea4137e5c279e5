"""Column-in, column-out expressions; nothing here runs outside the JVM."""
