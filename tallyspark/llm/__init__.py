"""Training-data operators: one module each, none of them used by the rest of the library."""
