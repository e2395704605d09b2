"""Errors that a statement can end with."""


class EngineError(Exception):
    """Any failure that the engine reports itself."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""


class AnalysisError(EngineError):
    """The statement names something that isn't there, or mixes types."""


class TableExists(AnalysisError):
    pass


class TableNotFound(AnalysisError):
    pass


class ColumnNotFound(AnalysisError):
    pass


class InvalidSchema(AnalysisError):
    pass


class TypeMismatch(AnalysisError):
    pass


class PrimaryKeyConflict(EngineError):
    def __init__(self, detail: str = ""):
        super().__init__(f"PRIMARY KEY CONFLICT{': ' + detail if detail else ''}")


class ConstraintViolation(EngineError):
    pass


class CommitConflict(EngineError):
    """Another writer committed first."""
