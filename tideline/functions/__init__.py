"""Column expressions of kernels, weights and measures."""
