"""Errors of the engine. Each is a ValueError, so callers that don't care for the kind need not know it."""


class VerdigraphError(ValueError):
    """Any error of the engine; `about` tells what it concerns (a rule, a file, a statement)."""

    def __init__(self, message: str, about: str | None = None):
        super().__init__(f"{about}: {message}" if about else message)
        self.about = about


class PolicyError(VerdigraphError):
    """A configuration file that doesn't pass its checks."""


class RuleError(VerdigraphError):
    """A rule that can't be read, or whose parts don't fit together."""


class StatementError(VerdigraphError):
    """Text that is no statement."""


class PluginError(VerdigraphError):
    """A plugin whose manifest lacks something, or that doesn't provide what it says."""


class StoreError(VerdigraphError):
    """Rows that a store doesn't take."""
