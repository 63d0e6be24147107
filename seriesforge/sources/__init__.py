"""File discovery, panel reading, snapshot publish/open, CSV export."""
