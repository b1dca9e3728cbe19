"""Inputs and the stored log table."""
