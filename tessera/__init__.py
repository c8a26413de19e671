"""Tessera: program-structure analytics expressed as Spark DataFrame jobs."""
