"""Column functions (Column -> Column), all JVM-side."""
