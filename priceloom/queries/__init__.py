"""Registered queries: every operator applied to the driver's tables, with the equivalent SQL beside it."""
