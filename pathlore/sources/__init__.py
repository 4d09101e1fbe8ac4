"""Readers and writers of recorded runs, logs and memories in any file system that Spark reaches."""
