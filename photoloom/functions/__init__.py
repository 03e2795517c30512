"""Column functions: text kernels, path and hash keys, vector arithmetic."""
