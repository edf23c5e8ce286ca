"""Status and log feeds on Structured Streaming, each with a batch twin."""
