"""Chat clients."""

from corvane.clients.chat import Answer, Chat, ChatError, EchoChat, Message, RemoteChat

__all__ = ["Answer", "Chat", "ChatError", "EchoChat", "Message", "RemoteChat"]
