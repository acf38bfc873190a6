"""Scans: open-contracting releases, feeds, sitemaps, posts, registries, files and page probes."""
