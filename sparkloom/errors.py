"""Errors of configuration and of services. Errors of a single document are columns of its row instead (schema.STATUS)."""

from __future__ import annotations

#: Kinds by name, as they are shown.
KINDS = ("invalid input", "i/o", "config", "internal", "embed", "sink", "state")


class LoomError(Exception):
    """An error of a kind, with contexts from the innermost outwards; blank contexts are left out."""

    def __init__(self, kind: str, message: str = "") -> None:
        if kind not in KINDS:
            raise ValueError(f"no such kind of error: {kind}")
        super().__init__(message)
        self.kind = kind
        self.contexts = [message.strip()] if message.strip() else []

    def within(self, context: str) -> LoomError:
        """The error as seen from further out."""
        if context.strip():
            self.contexts.append(context.strip())
        return self

    def __str__(self) -> str:
        return ": ".join([self.kind, *reversed(self.contexts)])
