"""Named queries: each with its Spark plan and, where there is one, its SQL."""
