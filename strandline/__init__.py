"""Conversation-memory analytics as Spark DataFrame operators."""
