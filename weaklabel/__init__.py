"""Weak supervision and cohort labelling as Spark DataFrame jobs."""

ABSTAIN = -1
CONTROL = 0
CASE = 1
