"""Column functions: no function here needs a shuffle or a Python worker."""
