"""Price-comparison jobs on Spark: offers, matching, comparison tables, history."""
