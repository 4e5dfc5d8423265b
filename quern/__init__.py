"""Quern: a Spark-native relational analytics engine with PostgreSQL-style semantics."""
