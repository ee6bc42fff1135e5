"""Column functions, kernels for Arrow functions and numeric solvers."""
