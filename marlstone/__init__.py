"""Marlstone: point-in-time market research analytics as Spark DataFrame transforms."""
