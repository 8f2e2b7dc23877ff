"""Structured Streaming jobs: micro-batch payload intake (T1) and the
stateful rate limiter (T2)."""
