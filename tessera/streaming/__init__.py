"""The encoder over Structured Streaming sources. It keeps no state between rows, so it needs no watermark."""
