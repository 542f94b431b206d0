"""Errors of driver-side calls. Inside a plan errors are columns: error_code and error_message."""


class FolioError(Exception):
    """Base of all errors of this package."""


class ApiError(FolioError):
    """A provider refused a call; carries its code and trace id."""

    def __init__(self, message: str, code: str | None = None, trace_id: str | None = None):
        super().__init__(message)
        self.code, self.trace_id = code, trace_id


class HttpError(FolioError):
    """A server refused a call; carries its status, as the code too, and what it says of when to try again."""

    def __init__(self, status: int, message: str, retry_after: str | None = None):
        super().__init__(f"{status}: {message}")
        self.status, self.code, self.retry_after = status, str(status), retry_after


class PlanError(FolioError):
    """A source can't be planned."""


class MergeError(FolioError):
    """Parts can't be merged, or an archive isn't safe."""


class EnrichError(FolioError):
    """A document can't be enriched."""
