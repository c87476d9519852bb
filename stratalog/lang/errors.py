"""Errors of programs. Each analysis error has a kind of its own."""


class ProgramError(Exception):
    """A program that cannot be used."""


class ParseError(ProgramError):
    """Text that is no program."""


class PredicateDefinedTwice(ProgramError): ...


class QueryDefinedTwice(ProgramError): ...


class RuleDefinedTwice(ProgramError): ...


class QueryUndefinedPredicate(ProgramError): ...


class QueryTypeMismatch(ProgramError): ...


class ShortClause(ProgramError):
    """An ordered clause with too few or too many matches."""


class MatchStyle(ProgramError):
    """A named clause on an ordered predicate, or the reverse."""


class DoubleBind(ProgramError): ...


class UndefinedField(ProgramError): ...


class UnboundHeadField(ProgramError): ...


class MissingHeadField(ProgramError): ...


class HeadPredUndefined(ProgramError): ...


class HeadTypeMismatch(ProgramError): ...


class VarNotFound(ProgramError): ...


class NameCollision(ProgramError):
    """Names that differ only in case."""


class UnknownName(ProgramError):
    """A type, constant, aggregator or callback that nobody has registered."""


class NoFixpoint(ProgramError):
    """A program that is still productive after the allowed rounds."""
