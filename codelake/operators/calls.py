"""Calls of user functions with a time limit, inside tasks."""

from __future__ import annotations

from collections.abc import Callable


def limited(fn: Callable, timeout_s: float, *args):
    """``fn(*args)``, or ``TimeoutError`` after ``timeout_s`` seconds.

    The call runs on a daemon thread: one that hangs is given up and ends with
    the worker process."""
    import queue
    import threading

    done: queue.Queue = queue.Queue()

    def work() -> None:
        try:
            done.put((fn(*args), None))
        except Exception as e:  # noqa: BLE001 - raised again by the caller
            done.put((None, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        out, error = done.get(timeout=timeout_s)
    except queue.Empty:
        raise TimeoutError(f"no answer within {timeout_s:g} s") from None
    if error is not None:
        raise error
    return out
