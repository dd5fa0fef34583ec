"""Operators: each takes data frames and returns one, lazily; nothing is collected."""
