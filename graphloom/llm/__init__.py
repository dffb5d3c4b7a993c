"""Operators for preparing training data, one module each; ``catalog`` registers their queries."""
