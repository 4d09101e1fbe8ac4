"""Streams: step flags, sessions and recent messages as events arrive, and an index that is rebuilt now and then."""
