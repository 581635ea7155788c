"""What can go wrong, by stage."""

from __future__ import annotations


class OrdinaleError(Exception):
    """Any error of this package."""


class ParseError(OrdinaleError):
    """The source text is malformed; start and end are character positions in it."""

    def __init__(self, message: str, start: int = 0, end: int = 0):
        super().__init__(f"{message} at {start}")
        self.message, self.start, self.end = message, start, end


class EvalError(OrdinaleError):
    """The program can't be evaluated."""


class UndefinedName(EvalError):
    pass


class EmptyProgram(EvalError):
    pass


class KindError(EvalError):
    """A verb has no form for these kinds."""


class ShapeError(EvalError):
    """Lengths don't agree, or a length or position is out of range."""


class Cancelled(EvalError):
    """The evaluation was interrupted."""
