"""Declarative query specifications and the named query shapes built on them."""
