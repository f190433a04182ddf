"""Core functions as column expressions."""
