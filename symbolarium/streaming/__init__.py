"""Streams: deliveries as they arrive. The batch operators' results, kept up to date."""
