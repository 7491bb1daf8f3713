"""Speech-timeline and voice-profile analytics as Spark DataFrame jobs."""
