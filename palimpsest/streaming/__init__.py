"""Sessions, bursts, queues and per-conversation state, on streams and on tables alike."""
