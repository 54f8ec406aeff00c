"""Typed failures: one exception class per category, each carrying a code."""

from __future__ import annotations

from pyspark.errors import PySparkException


class EngineError(Exception):
    category = "internalFailure"

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class InvalidRequest(EngineError):
    category = "invalidRequest"


class NotFound(EngineError):
    category = "notFound"


class Conflict(EngineError):
    category = "conflict"


class ConstraintViolation(EngineError):
    category = "constraint"


class ResourceLimit(EngineError):
    category = "resourceLimit"


class Unavailable(EngineError):
    category = "unavailable"


#: Spark error conditions by the category that a caller sees.
SPARK_CONDITIONS = {
    "TABLE_OR_VIEW_NOT_FOUND": (NotFound, "ENTITY_NOT_FOUND"),
    "UNRESOLVED_COLUMN": (InvalidRequest, "UNBOUND_VARIABLE"),
    "DATATYPE_MISMATCH": (InvalidRequest, "TYPE_ERROR"),
    "CAST_INVALID_INPUT": (InvalidRequest, "INVALID_LEXICAL_FORM"),
    "INVALID_PARAMETER_VALUE": (InvalidRequest, "INVALID_FUNCTION_ARGUMENTS"),
    "ARITHMETIC_OVERFLOW": (ResourceLimit, "AGGREGATE_RESULT_OUT_OF_RANGE"),
    "PARSE_SYNTAX_ERROR": (InvalidRequest, "INVALID_STATEMENT"),
}


def from_spark(error: PySparkException) -> EngineError:
    """The typed failure for a Spark error, by the first part of its condition name."""
    condition = (error.getCondition() or "").split(".")[0]
    kind, code = SPARK_CONDITIONS.get(condition, (EngineError, "QUERY_EXECUTION_FAILED"))
    return kind(code, str(error).split("\n")[0])
