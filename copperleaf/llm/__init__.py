"""Training-data operators: one module for each operator, its query and its SQL."""
