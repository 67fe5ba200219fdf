"""Named plans: the queries that the library registers, and their SQL."""
