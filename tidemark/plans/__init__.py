"""Ready-made plans: the registered queries and the combined series analysis."""
