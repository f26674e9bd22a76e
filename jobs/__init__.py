"""Runnable jobs: each has a function that takes a session, a command line and a small config file beside it."""
