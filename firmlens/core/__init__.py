"""Helpers shared by the operator families."""
