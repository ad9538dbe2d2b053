"""Readers: sensor folders, road networks, project documents, stored sections."""
