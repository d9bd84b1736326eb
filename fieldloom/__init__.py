"""fieldloom: scene, motion-log and radio-link analytics as Spark DataFrame jobs."""
