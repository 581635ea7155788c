"""Extension beyond the language itself: its aggregates over Structured Streaming sources."""
