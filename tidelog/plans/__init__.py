"""Typed requests, and the registered queries with their reference SQL."""
