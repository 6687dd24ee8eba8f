"""Changes of a working tree as a streaming source: ``spark.readStream.format("tree_events").load(root)``.

The option ``source`` selects what is watched: ``poll`` the times of files, ``git`` only those of
git's index and of the mark that hooks leave (cheap, for large trees that change by git alone),
``auto`` both, if the tree has git. Hooks are put there by ``install_hooks``.

The first batch asks for a full scan. Later ones hold the source files that were created or
changed since the last offset, and ask for a full scan when git's index has changed or files
have gone. Folders that are never source are not looked into. An offset is a time and the
number of files seen, so it stays small whatever the tree.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestone.functions.text import EXTENSIONS
from lodestone.sources import heuristics

SCHEMA = "file_path string, check_all boolean"
ENDINGS = tuple("." + e for own in EXTENSIONS.values() for e in own)


def scan(root: str) -> Iterator[tuple[str, float]]:
    """(path below the root, time of change) of files that may be source."""
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".") and not heuristics.is_blocked_folder(f)]
        for name in files:
            if name.endswith(ENDINGS) and not name.startswith("."):
                path = os.path.join(folder, name)
                try:
                    yield os.path.relpath(path, root), os.lstat(path).st_mtime
                except OSError:
                    continue


HOOKS = ("post-commit", "post-merge", "post-checkout", "post-rewrite")
MARK = "lodestone-changed"
LINE = f'touch "$(git rev-parse --git-dir)/{MARK}"  # lodestone'


def install_hooks(root: str) -> list[str]:
    """Hooks that mark a change of the tree; lines of other hooks stay. Returns the files."""
    folder = os.path.join(root, ".git", "hooks")
    if not os.path.isdir(os.path.join(root, ".git")):
        raise FileNotFoundError(f"{root} is no git repository")
    os.makedirs(folder, exist_ok=True)
    for path in (out := [os.path.join(folder, h) for h in HOOKS]):
        text = open(path, encoding="utf-8").read() if os.path.exists(path) else "#!/bin/sh\n"
        if LINE not in text:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text.rstrip("\n") + "\n" + LINE + "\n")
            os.chmod(path, 0o755)
    return out


def remove_hooks(root: str) -> None:
    """Takes the line out of the hooks; files with nothing else go."""
    for path in (os.path.join(root, ".git", "hooks", h) for h in HOOKS):
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                left = [x for x in f.read().splitlines() if x != LINE]
            if [x for x in left if x.strip() and not x.startswith("#!")]:
                with open(path, "w", encoding="utf-8") as f:
                    f.write("\n".join(left) + "\n")
            else:
                os.unlink(path)


class TreeEventReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, source: str = "auto") -> None:
        self.root = os.path.abspath(root)
        if source not in ("auto", "git", "poll"):
            raise ValueError(f"source must be auto, git or poll, not {source!r}")
        if source == "git" and not os.path.isdir(os.path.join(self.root, ".git")):
            raise FileNotFoundError(f"{root} is no git repository")
        self.polls, self.asks_git = source != "git", source != "poll"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1.0, "files": 0, "git": 0.0}

    def _state(self, since: float) -> tuple[list[str], dict]:
        fresh, n, last = [], 0, since
        for path, changed in scan(self.root) if self.polls else ():
            n += 1
            last = max(last, changed)
            if changed > since:
                fresh.append(path)
        git = 0.0
        for name in ("index", MARK) if self.asks_git else ():
            try:
                git = max(git, os.path.getmtime(os.path.join(self.root, ".git", name)))
            except OSError:
                pass
        return sorted(fresh), {"at": max(last, 0.0), "files": n, "git": git}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        fresh, end = self._state(start["at"])
        if start["at"] < 0 or end["git"] != start["git"] or end["files"] < start["files"]:
            return iter([(None, True)]), end
        if end == start:
            time.sleep(0.05)
        return iter([(p, False) for p in fresh]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        # a batch that runs again after a failure: a full scan finds all that it held
        return iter([(None, True)]) if start != end else iter([])

    def commit(self, end: dict) -> None:
        return


class TreeEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802
        return TreeEventReader(self.options["path"], self.options.get("source", "auto"))
