"""Lodeweave: fact tables, graph operators and code-analysis verbs as Spark plans."""
