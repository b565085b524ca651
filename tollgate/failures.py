"""Exit codes: what may be retried, and what will not change by retrying."""

from __future__ import annotations

from .contract import TollgateError

OK, TRANSIENT, CORRECTNESS = 0, 1, 2
#: Marks of a fault outside this engine that may pass; fixed values.
_PASSING = (
    "FetchFailed", "ExecutorLost", "Connection refused", "Connection reset", "timed out", "TimeoutException", "SocketException", "UnknownHostException",
    "Too Many Requests", "503 ",
)
#: Marks of what retrying does not change, however it is wrapped: full disks and heaps come back, and so do missing rights; fixed values.
_STAYING = (
    "No space left on device", "OutOfMemoryError", "AuthenticationError", "Unauthorized", "PermissionError", "AccessControlException", "AccessDenied", "Access Denied", "401 ", "403 ",
)


def chain(error: BaseException) -> list[BaseException]:
    """The error and everything that caused it, each once."""
    out: list[BaseException] = []
    todo: list[BaseException | None] = [error]
    while todo:
        e = todo.pop()
        if e is not None and all(e is not seen for seen in out):
            out.append(e)
            todo += [e.__cause__, e.__context__]
    return out


def classify(error: BaseException) -> int:
    """1 for a fault known to pass, else 2.

    A refusal of this engine, a failed assertion, or a fault that stays, anywhere in the chain, wins
    over a fault that may pass.
    """
    causes = chain(error)
    if any(isinstance(e, (TollgateError, AssertionError, PermissionError, MemoryError)) for e in causes):
        return CORRECTNESS
    if any(m in f"{type(e).__name__}: {e}" for e in causes for m in _STAYING):
        return CORRECTNESS
    if any(isinstance(e, (ConnectionError, TimeoutError)) or any(m in str(e) for m in _PASSING) for e in causes):
        return TRANSIENT
    return CORRECTNESS
