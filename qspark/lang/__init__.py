"""The query language's front end: reader, values, interpreter."""

from .interpreter import Interpreter
from .reader import parse

__all__ = ["Interpreter", "parse"]
