"""Reservation analytics as Spark DataFrame jobs."""
