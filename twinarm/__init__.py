"""Two-arm longitudinal cohort analysis as Spark DataFrame operators."""
