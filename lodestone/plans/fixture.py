"""A small source tree in seven languages, and what an index has to find in it; no table of the driver holds a tree."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from lodestone.session import shared_folder

TREE = {
    "services/auth/login.py": '''
def authenticate_user(username: str, password: str) -> bool:
    """Says whether the user may come in."""
    stored = load_user(username)
    return check_password_hash(stored, password)

def check_password_hash(stored: bytes, password: str) -> bool:
    """Compares a password with its hash."""
    raw = password.encode()
    return compare(stored, raw)

class UserSession:

    def __init__(self, user_id: int):
        self.user_id = user_id

    def generate_token(self):
        """Makes a token."""
        return self.user_id.encode()
''',
    "services/payments/processor.rs": """
pub fn process_payment(amount: f64) -> Result<String, Error> {
    if amount <= 0.0 {
        return Err(Error::Bad);
    }
    charge_card(amount)
}

fn charge_card(amount: f64) -> Result<String, Error> {
    Ok(receipt(amount))
}
""",
    "frontend/src/api.ts": """
export async function fetchUserProfile(userId: string): Promise<User> {
  const response = await fetch(`/api/users/${userId}`);
  return response.json();
}

class ApiClient {
  constructor(base: string) {
    this.base = base;
  }
  async get(path: string): Promise<any> {
    return fetch(this.base + path);
  }
}
""",
    "cmd/main.go": "package main\n\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Run() error {\n\treturn listen(s.port)\n}\n\nfunc main() {\n\tstart()\n}\n",
    "core/Ledger.java": "class Ledger {\n  int total(int a) {\n    return add(a);\n  }\n}\n",
    "native/sum.cpp": "static int sum(int a) {\n  return plus(a);\n}\n",
    "web/boot.js": "function boot() {\n  ready();\n}\n",
    "pkg/__init__.py": "def hidden_name():\n    return 1\n",
    # what a scan leaves out
    ".gitignore": "skipped/\n*.tmp.py\n!kept.tmp.py\n",
    "skipped/a.py": "def a(): pass\n",
    "b.tmp.py": "def b(): pass\n",
    "kept.tmp.py": "LIMIT = 1\n",
    "__pycache__/x.py": "def x(): pass\n",
    "types.d.ts": "export function t(): void;\n",
    "long.js": "x" * 600 + "\n",
    "zero.py": "a\0b",
    "notes.txt": "text\n",
    "gen.go": "// Code generated by x. DO NOT EDIT.\npackage a\n",
}
KEPT = ["cmd/main.go", "core/Ledger.java", "frontend/src/api.ts", "kept.tmp.py", "native/sum.cpp", "pkg/__init__.py", "services/auth/login.py", "services/payments/processor.rs", "web/boot.js"]

#: (file_path, name, unit_type, line_start, line_end, calls) as the rules of extraction give them.
UNITS = [
    ("cmd/main.go", "Run", "method", 7, 9, "listen"),
    ("cmd/main.go", "Server", "struct", 3, 5, ""),
    ("cmd/main.go", "main", "function", 11, 13, "start"),
    ("core/Ledger.java", "Ledger", "class", 1, 5, ""),
    ("core/Ledger.java", "total", "method", 2, 4, "add"),
    ("frontend/src/api.ts", "ApiClient", "class", 7, 14, ""),
    ("frontend/src/api.ts", "constructor", "method", 8, 10, ""),
    ("frontend/src/api.ts", "fetchUserProfile", "function", 2, 5, "fetch,json"),
    ("frontend/src/api.ts", "get", "method", 11, 13, "fetch"),
    ("native/sum.cpp", "sum", "function", 1, 3, "plus"),
    ("pkg/__init__.py", "hidden_name", "function", 1, 2, ""),
    ("services/auth/login.py", "UserSession", "class", 12, 19, ""),
    ("services/auth/login.py", "__init__", "function", 14, 15, ""),
    ("services/auth/login.py", "authenticate_user", "function", 2, 5, "check_password_hash,load_user"),
    ("services/auth/login.py", "check_password_hash", "function", 7, 10, "compare,encode"),
    ("services/auth/login.py", "generate_token", "function", 17, 19, "encode"),
    ("services/payments/processor.rs", "charge_card", "function", 9, 11, "Ok,receipt"),
    ("services/payments/processor.rs", "process_payment", "function", 2, 7, "Err,charge_card"),
    ("web/boot.js", "boot", "function", 1, 3, "ready"),
]

#: What follows: one file changed, one gone, one new.
CHANGED = {"services/auth/login.py": "def oauth_login():\n    return refresh()\n\ndef refresh():\n    return 1\n", "core/New.java": "class New {\n}\n"}
GONE = "web/boot.js"

#: (step, indexed, skipped, removed, new_units) of the runs of ``index_runs`` below.
STEPS = [("1 first", 9, 0, 0, 19), ("2 again", 0, 9, 0, 0), ("3 changed", 2, 7, 1, 3), ("4 paths", 1, 0, 0, 1), ("5 cleanup", 0, 0, 1, 1), ("6 rebuild", 9, 0, 0, 16)]

#: Rows of the tables after the changes without the loss.
ROWS = [("units", 17), ("edges", 13), ("files", 10), ("vectors", 17), ("recorded units", 17), ("recorded files", 10), ("pending", 0), ("coverage", 100)]

#: (name, line_start, first line of the body) of the units of services/auth/login.py.
LOGIN = [("UserSession", 12, "class UserSession:"), ("__init__", 14, "def __init__(self, user_id: int):"), ("authenticate_user", 2, "def authenticate_user(username: str, password: str) -> bool:"), ("check_password_hash", 7, "def check_password_hash(stored: bytes, password: str) -> bool:"), ("generate_token", 17, "def generate_token(self):")]

#: (query, rank, name) of the best result of searches in the stored index.
FOUND = [("process_payment", 1, "process_payment"), ("authenticate_user", 1, "authenticate_user"), ("name:boot", 1, "boot"), ('"response json" -password', 1, "fetchUserProfile"), ("+encode +raw", 1, "check_password_hash")]


def local(path: str) -> str:
    """A file URI as a path."""
    return path.removeprefix("file://").removeprefix("file:")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the parts of a query that need a mounted file system."""
    at = os.path.join(local(shared_folder(spark)), f"{name}-{spark._jvm.java.util.UUID.randomUUID()}")
    os.makedirs(at)
    return at


def plant(root: str, files: dict[str, str] = TREE) -> str:
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return root
