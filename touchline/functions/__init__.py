"""Column functions: boxes, geometry, text and time."""
