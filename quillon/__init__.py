"""quillon: repository-assessment analytics on Spark."""
