"""Structured Streaming: sources, windowed and stateful operators, runs to completion."""
