"""Status codes: exceptions carry them, and a small table maps them to exit statuses and message prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stable codes, exit statuses and message prefixes.
STATUS = [
    ("internal_error", 1, "internal error: "),
    ("invalid_arguments", 2, "invalid arguments: "),
    ("display_unavailable", 3, "unable to connect to X11 display "),
    ("invalid_region", 4, "invalid region: "),
    ("window_not_found", 5, "X11 window not found: "),
    ("capture_failed", 6, "capture failed: "),
    ("resize_failed", 7, "resize failed: "),
    ("encode_failed", 8, "encode failed: "),
    ("output_failed", 9, "output failed: "),
    ("incompatible_frames", 10, "incompatible frames: "),
    ("comparison_failed", 11, "comparison failed: "),
    ("image_load_failed", 12, "image load failed: "),
    ("geometry_changed", 13, "geometry changed: "),
    ("target_lost", 14, "target lost: "),
    ("invalid_duration", 15, "invalid duration: "),
    ("observation_failed", 16, "observation failed: "),
    ("session_not_found", 17, "session not found: "),
    ("session_busy", 18, "session busy: "),
    ("session_closed", 19, "session closed: "),
    ("frame_not_available", 20, "frame not available: "),
    ("no_frame_available", 21, "no frame available: "),
    ("service_unavailable", 22, "service unavailable: "),
    ("service_protocol_error", 23, "service protocol error: "),
    ("service_overloaded", 24, "service overloaded: "),
    ("invalid_presentation_policy", 25, "invalid presentation policy: "),
    ("payload_budget_exceeded", 26, "payload budget exceeded: "),
]
#: An outcome, not an error.
TIMEOUT_STATUS = 100
#: Codes after which a session is failed.
FATAL = ("session_not_found", "session_closed", "target_lost", "display_unavailable")

_EXIT = {code: status for code, status, _ in STATUS}
_PREFIX = {code: prefix for code, _, prefix in STATUS}


class EngineError(Exception):
    """An error with a stable code."""

    def __init__(self, code: str, detail: str = ""):
        if code not in _EXIT:
            raise ValueError(f"unknown code {code!r}")
        self.code, self.exit_status = code, _EXIT[code]
        super().__init__(f"{_PREFIX[code]}{detail}")


def message(code: Column, prefix: Column, detail: Column, display: Column, window: Column) -> Column:
    """The message of a status: its prefix and what is known; a display's name stands before the detail, a missing window's
    id in its place."""
    return (
        F.when(code == "display_unavailable", F.concat(prefix, display, F.lit(": "), detail))
        .when(code == "window_not_found", F.concat(prefix, window))
        .otherwise(F.concat(prefix, detail))
    )


def status_table(spark: SparkSession) -> DataFrame:
    """code, exit_status, prefix, session_fatal."""
    rows = spark.createDataFrame(STATUS, "code string, exit_status int, prefix string")
    return rows.withColumn("session_fatal", is_session_fatal(F.col("code")))


def is_session_fatal(code: Column) -> Column:
    return code.isin(*FATAL)


def from_service_code(code: Column, message: Column) -> Column:
    """struct(code, message): an unknown code becomes a protocol error that names it."""
    known = code.isin(*[c for c in _EXIT if c != "internal_error"])
    strange = F.concat(
        F.lit('the service reported "'), code, F.lit('", which this client does not recognise: '), message
    )
    return F.struct(
        F.when(known, code).otherwise(F.lit("service_protocol_error")).alias("code"),
        F.when(known, message).otherwise(strange).alias("message"),
    )


def error_to_json(code: Column, message: Column) -> Column:
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error")))
