"""Column functions: paths, text, formats. All of them are expressions that stay in the JVM."""
