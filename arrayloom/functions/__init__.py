"""Column functions: locations, element types, image geometry."""
