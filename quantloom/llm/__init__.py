"""Operators for preparing training text and embeddings at cluster scale.

Nothing else in the package imports this one; its queries are added to the
registry only where it is present.
"""
