"""Cryptographic inventory analytics expressed as Spark DataFrame jobs."""
