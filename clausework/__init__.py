"""Evidence mapping on Spark: layouts to clauses, clauses to ranked checklists."""
