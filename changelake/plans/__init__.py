"""Larger plans put together from the operators: the query suite and table maintenance."""
