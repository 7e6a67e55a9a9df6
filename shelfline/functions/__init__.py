"""Formulas as Spark SQL expressions, applied by DataFrame stages; nothing here shuffles."""
