"""Find, score and remove sensitive data in tables of documents with Spark."""

from veilspark.functions.patterns import DEFAULT_RULES, EXTENDED_RULES, Rule

__all__ = ["DEFAULT_RULES", "EXTENDED_RULES", "Rule"]
