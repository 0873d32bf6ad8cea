"""Measures of small graphs, on the driver: a network has at most `top_n` nodes by construction."""
