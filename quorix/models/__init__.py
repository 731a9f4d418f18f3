"""Local kernels and distributed models."""
