"""Column expressions shared by the operators; all run inside the JVM."""
