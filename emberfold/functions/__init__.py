"""Scalar functions: column expressions that stay inside code generation."""
