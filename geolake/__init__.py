"""geolake: geospatial and movement analytics expressed as Spark jobs."""
