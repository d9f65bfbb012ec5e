"""Tidewell: block-structured transfer analytics and corpus operators on Spark."""
