"""A deadline for each row: one slow, failing or crashing row costs itself, not its batch."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_FORK = multiprocessing.get_context("fork")


def _serve(make: Callable[[], Callable[[dict], str | None]], pipe: object) -> None:
    """Runs in the child: one answer for each row that comes, until the pipe ends."""
    work = make()
    pipe.send(("ready", None))
    while True:
        try:
            row = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send(("done", work(row)))
        except Exception as e:
            pipe.send(("failed", f"{type(e).__name__}: {e}"))


class Watchdog:
    """Runs rows in a child process, which is ended and replaced when a row takes over ``seconds``.

    ``make`` is called once in each child and gives the function that takes a
    row; so models are loaded once for each child, and the loading is bounded by
    ``start_seconds`` and not charged to a row.
    """

    def __init__(self, make: Callable[[], Callable[[dict], str | None]], seconds: float, start_seconds: float = 600.0):
        self.make, self.seconds, self.start_seconds = make, seconds, start_seconds
        self.child: multiprocessing.process.BaseProcess | None = None
        self.pipe: object = None
        #: Children that were begun.
        self.begun = 0

    def _start(self) -> None:
        self.pipe, theirs = _FORK.Pipe()
        self.child = _FORK.Process(target=_serve, args=(self.make, theirs), daemon=True)
        self.child.start()
        self.begun += 1
        theirs.close()
        if not self.pipe.poll(self.start_seconds):
            self.stop()
            raise TimeoutError(f"a worker was not ready after {self.start_seconds} seconds")
        try:
            self.pipe.recv()
        except EOFError:
            self.stop()
            raise RuntimeError("a worker ended before it was ready") from None

    def stop(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
        self.child = self.pipe = None

    def run(self, row: dict) -> tuple[str | None, str | None]:
        """(result, reason): the reason is null where there is a result."""
        if self.child is None:
            self._start()
        try:
            self.pipe.send(row)
            if not self.pipe.poll(self.seconds):
                self.stop()
                return None, "timed out"
            kind, value = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.stop()
            return None, "worker died"
        if kind == "failed":
            return None, value
        return value, None if value is not None else "no result"


def answer_rows(requests: DataFrame, make: Callable[[], Callable[[dict], str | None]], seconds: float, start_seconds: float = 600.0) -> DataFrame:
    """(id, result, reason) for each request: its result, or why there is none.

    ``make`` gives a function from a row, as a dict, to its result. A row that
    takes over ``seconds`` is "timed out", one whose function raises has the
    error, one that ends its process is "worker died"; the others of its task
    are answered. A task holds one child process and one batch of rows.
    """
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dog = Watchdog(make, seconds, start_seconds)
        try:
            for batch in batches:
                rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
                found = [dog.run({n: r[n] for n in names}) for r in rows]
                yield pd.DataFrame({"id": batch["id"], "result": [r for r, _ in found], "reason": [w for _, w in found]}, dtype=object)
        finally:
            dog.stop()

    return requests.mapInPandas(run, "id string, result string, reason string")
