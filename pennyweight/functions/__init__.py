"""functions of the engine; see the modules inside."""
