"""Column expressions and the NumPy kernels that run inside Arrow tasks."""
