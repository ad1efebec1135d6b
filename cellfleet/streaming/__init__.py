"""Structured Streaming jobs that must agree with their batch counterparts."""
