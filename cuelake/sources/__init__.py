"""Readers of segment tables and logs, writers of subtitles and edit lists."""
