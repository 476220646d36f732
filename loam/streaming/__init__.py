"""Streams and resumable loops: taking in new pages, rate limits per domain, suggestions, crawling."""
