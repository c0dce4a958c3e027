"""Licence and platform-terms analytics for fleets of projects, on Spark."""
