"""Column expressions and small pixel kernels."""
