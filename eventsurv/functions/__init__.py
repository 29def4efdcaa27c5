"""Column-expression builders (JVM-side, codegen-friendly; no UDFs)."""
