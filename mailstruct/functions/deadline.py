"""Supplied callables with a time limit: a call that hangs costs its limit and neither its task nor the calls after it."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import Any


class CallFailed(Exception):
    """What the callable raised, by type and text."""


def serve(call: Callable[[Any], Any], own: Connection, other: Connection) -> None:
    """The child's loop. It ends with the process that started it, since that closes the last other end."""
    other.close()
    while True:
        try:
            argument = own.recv()
        except (EOFError, OSError):
            return
        try:
            answer = (True, call(argument))
        except BaseException as e:  # noqa: BLE001  any failure is an answer
            answer = (False, f"{type(e).__name__}: {e}")
        try:
            own.send(answer)
        except Exception as e:  # noqa: BLE001  a value that can't be sent
            own.send((False, f"{type(e).__name__}: {e}"))


class Limited:
    """call(argument) in a child process of this one. TimeoutError after so many seconds, with the child killed and a new one for the next
    call; CallFailed if it raises or its process dies. The child keeps what the callable has loaded from one call to the next."""

    def __init__(self, call: Callable[[Any], Any], seconds: float):
        self.call, self.seconds, self.child, self.pipe = call, seconds, None, None

    def __getstate__(self) -> dict:
        return {"call": self.call, "seconds": self.seconds, "child": None, "pipe": None}

    def __call__(self, argument: Any) -> Any:
        if self.child is None or not self.child.is_alive():
            self.start()
        try:
            self.pipe.send(argument)
            if not self.pipe.poll(self.seconds):
                raise TimeoutError(f"no answer within {self.seconds:g} s")
            sound, value = self.pipe.recv()
        except (EOFError, OSError) as e:
            self.stop()
            if isinstance(e, TimeoutError):
                raise
            raise CallFailed("ChildProcessError: the process died") from None
        if not sound:
            raise CallFailed(value)
        return value

    def start(self) -> None:
        self.stop()
        # forked, since callables that Spark has sent by value can't be sent again by name
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.child = context.Process(target=serve, args=(self.call, theirs, self.pipe), daemon=True)
        self.child.start()
        theirs.close()

    def stop(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
        self.child = self.pipe = None


def problem(error: Exception) -> str:
    """An error's type and text."""
    return str(error) if isinstance(error, CallFailed) else f"{type(error).__name__}: {error}"
