"""The checked queries: each a thin call of an operator, beside its SQL."""
