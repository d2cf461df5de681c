"""Spark jobs for archives of speaker-attributed meeting transcripts."""
