"""Queue workers as Structured Streaming jobs over folders of JSON messages."""
