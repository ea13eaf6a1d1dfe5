"""Pagewright: document retrieval, typed tables and answer checking as Spark DataFrame operations."""
