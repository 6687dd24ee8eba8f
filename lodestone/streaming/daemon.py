"""Watching as a service: start, stop and status of the query that keeps an index fresh.

The service lives in the driver that started it; a state file beside the index tells others of it.
"""

from __future__ import annotations

import json
import os
import socket
import time
from dataclasses import asdict, dataclass

from pyspark.sql.streaming import StreamingQuery

from lodestone import config
from lodestone.api import CodeIndex


@dataclass(frozen=True)
class State:
    host: str
    pid: int
    started_at: int
    path: str
    repo: str
    query: str


class Daemon:
    """One service for each index."""

    def __init__(self, index: CodeIndex) -> None:
        self.index, self.file = index, f"{index.root}/daemon.json"

    def state(self) -> State | None:
        """What the state file says; None if there is none or it cannot be read."""
        try:
            with open(self.file, encoding="utf-8") as f:
                return State(**json.load(f))
        except (OSError, ValueError, TypeError):
            return None

    def query(self) -> StreamingQuery | None:
        """The running query, in the driver that started it."""
        state = self.state()
        return next((q for q in self.index.spark.streams.active if state and q.id == state.query), None)

    def status(self) -> str:
        """``running``, ``stopped``, or ``stale`` for a state that a dead process left. Nothing is known of other hosts: their services count as running."""
        state = self.state()
        if state is None:
            return "stopped"
        if state.host != socket.gethostname():
            return "running"
        if state.pid == os.getpid():
            return "running" if self.query() else "stale"
        try:
            os.kill(state.pid, 0)
            return "running"
        except PermissionError:
            return "running"
        except OSError:
            return "stale"

    def start(self, path: str, repo: str, seconds: int | None = 5, source: str = "auto") -> State:
        """Starts watching; an error if a service runs already. A stale state is replaced."""
        if self.status() == "running":
            raise RuntimeError(f"{self.file}: watched already")
        query = self.index.watch(path, repo, f"{self.index.root}/watch", seconds, source)
        state = State(socket.gethostname(), os.getpid(), int(time.time()), os.path.abspath(path), repo, query.id)
        config.write_whole(self.file, json.dumps(asdict(state), indent=2))
        return state

    def stop(self) -> bool:
        """Stops the service of this driver and forgets a stale one. Says whether there was one."""
        state = self.state()
        if state is None:
            return False
        query = self.query()
        if query is None and self.status() == "running":
            raise RuntimeError(f"process {state.pid} on {state.host} watches; stop it there")
        if query is not None:
            query.stop()
        os.unlink(self.file)
        return True
