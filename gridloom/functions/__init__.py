"""Column functions (JVM-side) and NumPy kernels that operators are made of."""
