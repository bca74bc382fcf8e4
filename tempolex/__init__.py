"""Timed-text analytics on Spark DataFrames: subtitles, transcripts, their quality and their alignment."""
