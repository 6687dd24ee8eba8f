"""User settings, the registry of repositories and index metadata, as small files written by rename."""

from __future__ import annotations

import dataclasses
import json
import os
import socket
import tomllib
import uuid
from dataclasses import dataclass, field

from lodestone.functions.text import parse_bool

VERSION = 1


def write_whole(path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    draft = f"{path}.{os.getpid()}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


@dataclass
class Config:
    """A flag given in a call comes before a setting, a setting before its default."""

    limit: int = 10
    no_tui: bool = False
    format: str | None = None
    exclude_tests: bool = False
    auto_index: bool = False
    command: str | None = None

    # The keys and what they are for.
    KEYS = {
        "search.limit": ("limit", "Default number of results"),
        "search.no_tui": ("no_tui", "Always plain text"),
        "search.format": ("format", "Default output format (plain / json / csv)"),
        "search.exclude_tests": ("exclude_tests", "Always exclude test files"),
        "index.auto_index": ("auto_index", "Index when no index is found"),
        "editor.command": ("command", "Editor for results"),
    }

    @classmethod
    def load(cls, path: str) -> Config:
        """Anything unreadable gives the defaults."""
        try:
            with open(path, "rb") as f:
                raw = tomllib.load(f)
            out = cls()
            for key, (name, _) in cls.KEYS.items():
                section, _, item = key.partition(".")
                if item in raw.get(section, {}):
                    setattr(out, name, raw[section][item])
            return out
        except (OSError, ValueError, AttributeError):
            return cls()

    def save(self, path: str) -> None:
        sections: dict[str, list[str]] = {}
        for key, (name, _) in self.KEYS.items():
            section, _, item = key.partition(".")
            value = getattr(self, name)
            if value is not None:
                sections.setdefault(section, []).append(f"{item} = {json.dumps(value)}")
        write_whole(path, "\n".join(f"[{s}]\n" + "\n".join(lines) + "\n" for s, lines in sections.items()))

    def _name(self, key: str) -> str:
        if key not in self.KEYS:
            raise KeyError(f"unknown key {key!r}; known are {', '.join(self.KEYS)}")
        return self.KEYS[key][0]

    def set(self, key: str, value: str) -> None:
        name = self._name(key)
        if name == "limit":
            if not value.isdigit():
                raise ValueError("search.limit must be a number")
            self.limit = int(value)
        elif name == "format":
            if value not in ("plain", "json", "csv"):
                raise ValueError("search.format must be plain, json or csv")
            self.format = value
        elif name == "command":
            self.command = None if value in ("", "auto") else value
        else:
            setattr(self, name, parse_bool(value))

    def get(self, key: str) -> str:
        value = getattr(self, self._name(key))
        if value is None:
            return {"search.format": "plain", "editor.command": "(auto-detect)"}[key]
        return str(value).lower() if isinstance(value, bool) else str(value)

    def list(self) -> list[tuple[str, str, str]]:
        return [(k, self.get(k), about) for k, (_, about) in self.KEYS.items()]


@dataclass(frozen=True)
class Repo:
    name: str
    path: str
    added_at: int


class Registry:
    """Repositories by name, in the order they were added."""

    def __init__(self, path: str) -> None:
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                self.entries = [Repo(**x) for x in json.load(f)]
        except OSError:
            self.entries = []

    def save(self) -> None:
        write_whole(self.path, json.dumps([dataclasses.asdict(e) for e in self.entries], indent=2))

    def add(self, name: str, path: str, now: int) -> None:
        if self.find(name):
            raise ValueError(f"a repository {name!r} is registered already")
        self.entries.append(Repo(name, path, now))
        self.save()

    def remove(self, name: str) -> bool:
        left = [e for e in self.entries if e.name != name]
        changed = len(left) < len(self.entries)
        self.entries = left
        self.save()
        return changed

    def find(self, name: str) -> Repo | None:
        return next((e for e in self.entries if e.name == name), None)

    def resolve(self, names: str) -> list[Repo]:
        """Entries of names separated by commas; an unknown one is an error."""
        out = []
        for name in (n.strip() for n in names.split(",")):
            if name:
                entry = self.find(name)
                if entry is None:
                    raise KeyError(f"no repository {name!r}")
                out.append(entry)
        return out


@dataclass
class Metadata:
    """All that makes a state of an index live, in one file: the segments it consists of and what they add up to."""

    version: int = VERSION
    created_at: int = 0
    last_updated: int = 0
    checksum: str = ""
    num_files: int = 0
    num_units: int = 0
    commit: int = 0
    segments: list[str] = field(default_factory=list)
    sums: list[int] = field(default_factory=lambda: [0, 0])

    @classmethod
    def load(cls, path: str) -> Metadata:
        try:
            with open(path, encoding="utf-8") as f:
                return cls(**json.load(f))
        except OSError:
            return cls()

    def save(self, path: str) -> None:
        write_whole(path, json.dumps(dataclasses.asdict(self), indent=2))

    def migrate(self) -> bool:
        """Brings an older state up; a newer one than this code knows is an error. Says whether anything changed."""
        if self.version > VERSION:
            raise RuntimeError(f"index version {self.version} is newer than {VERSION}")
        changed = self.version < VERSION
        self.version = VERSION
        return changed


class Locked(RuntimeError):
    """Another process works on the index."""


class Lock:
    """Use of an index, by one process that changes it or by any number of ``shared`` ones that must not see it change.

    Fails at once if another holder is in the way. Each holder has a file that names its host and
    process. What a dead process of this host left behind is removed; a holder on another host
    counts as alive, as nothing can be known of it from here: remove its file by hand.
    """

    def __init__(self, path: str, shared: bool = False) -> None:
        self.path, self.shared = path, shared
        self.own = f"{path}.shared.{uuid.uuid4().hex}" if shared else path

    def _create(self, path: str) -> bool:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(f"{socket.gethostname()} {os.getpid()}")
        try:
            os.link(draft, path)  # whole, and only if there is none
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def _lives(self, path: str) -> bool:
        """Whether a holder is there; the file of one that is surely dead goes."""
        try:
            with open(path, encoding="utf-8") as f:
                host, _, pid = f.read().partition(" ")
            if host != socket.gethostname():
                return True
            os.kill(int(pid), 0)
            return True
        except FileNotFoundError:
            return False
        except PermissionError:
            return True
        except (OSError, ValueError):
            try:
                os.unlink(path)
            except FileNotFoundError:
                pass
            return False

    def _readers(self) -> list[str]:
        folder, name = os.path.split(self.path)
        return [os.path.join(folder, f) for f in os.listdir(folder or ".") if f.startswith(f"{name}.shared.") and not f.endswith(".tmp")]

    def __enter__(self) -> Lock:
        if self.shared:
            self._create(self.own)
            if self._lives(self.path):
                os.unlink(self.own)
                raise Locked(f"{self.path}: another process changes this index")
            return self
        if not self._create(self.path) and (self._lives(self.path) or not self._create(self.path)):
            raise Locked(f"{self.path}: another process works on this index")
        if any(self._lives(r) for r in self._readers()):
            os.unlink(self.path)
            raise Locked(f"{self.path}: another process reads this index")
        return self

    def __exit__(self, *_: object) -> None:
        os.unlink(self.own)
