"""Column functions: everything here is a built-in expression that stays in the JVM."""
