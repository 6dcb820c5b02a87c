"""Page events, circuit breaking and page-at-a-time runs as Structured Streaming."""
