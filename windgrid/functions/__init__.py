"""Column expressions: geometry, vectors, kernels, confidences, cleaning, bands. No I/O, no actions, no UDFs."""
