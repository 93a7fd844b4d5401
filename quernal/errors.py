"""The two severities that end a statement."""


class EngineError(Exception):
    """A user's error: bad text, wrong types, a name that does not exist."""


class EngineFatalError(EngineError):
    """A broken invariant of the engine or its storage."""
