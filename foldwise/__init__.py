"""Validation analytics for binary predictive models, expressed as Spark DataFrame jobs."""
