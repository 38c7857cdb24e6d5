"""The driver's query catalogue with its SQL counterparts."""
