"""Registered queries: derived inputs, and each operator applied to them."""
