"""Linking messy business records to a large registry, as Spark jobs."""
