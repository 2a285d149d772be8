"""Readers. Each stream reader gives ``message_id, value, publish_time``."""
