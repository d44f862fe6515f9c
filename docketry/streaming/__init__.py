"""Structured Streaming counterparts of resumable batch jobs."""
