"""Scalar functions: hashes, bit tricks and prime-field arithmetic."""
