"""wattsift: consumption-risk analytics for electricity billing data, as Spark jobs."""
