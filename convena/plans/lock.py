"""A lock for scheduled runs, held by a file on the machine that starts them; one left behind goes stale."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

#: Seconds after which a lock counts as left behind, and the exit code of a run that finds it held.
STALE, HELD = 6 * 3600, 75


class RunIsActive(RuntimeError):
    pass


@contextmanager
def run_lock(path: str | Path, stale: float = STALE, now=time.time) -> Iterator[None]:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(2):
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if now() - path.stat().st_mtime < stale:
                raise RunIsActive(str(path)) from None
            path.unlink(missing_ok=True)
    else:
        raise RunIsActive(str(path))
    try:
        yield
    finally:
        path.unlink(missing_ok=True)
