import json
import os

import pytest

from pyspark.sql import functions as F

from lodestone import config
from lodestone.api import CodeIndex
from lodestone.operators import changes
from lodestone.sources import parse, sinks, tree, vector_file
from lodestone.streaming import events, watch
from lodestone.streaming.daemon import Daemon

FILES = {
    "services/auth/login.py": '''
def authenticate_user(username: str, password: str) -> bool:
    """Check whether the user may come in."""
    return check_password_hash(username, password)


class UserSession:
    def __init__(self, user_id: int):
        self.user_id = user_id

    def generate_token(self):
        """Make a token."""
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
    Ok("done".into())
}
""",
    "frontend/api.ts": """
export async function fetchUserProfile(userId: string): Promise<User> {
  const response = await fetch(`/api/users/${userId}`);
  return response.json();
}

export const formatCurrency = (n: number): string => new Intl.NumberFormat('en').format(n);

class ApiClient {
  constructor(base: string) {
    this.base = base;
  }
  async get(path: string): Promise<any> {
    return fetch(this.base + path);
  }
}
""",
    "pkg/__init__.py": "def hidden_name():\n    return 1\n",
}


def plant(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    plant(root / "repo", FILES)
    index = CodeIndex(spark, str(root / "index"))
    counts = index.index(str(root / "repo"), "repo", now=1000)
    return index, root / "repo", counts


def test_units_and_edges(built):
    index, _, counts = built
    assert counts == {"indexed": 4, "skipped": 0, "removed": 0, "new_units": 12}
    units = {r["name"]: r for r in index.table("units").collect()}
    assert set(units) == {"authenticate_user", "UserSession", "__init__", "generate_token", "process_payment", "charge_card", "fetchUserProfile", "formatCurrency", "ApiClient", "constructor", "get", "hidden_name"}
    assert units["authenticate_user"]["full_signature"] == "def authenticate_user(username:" and units["authenticate_user"]["docstring"].startswith("Check")
    assert units["process_payment"]["calls"] == ["Err", "charge_card"] and (units["process_payment"]["line_start"], units["process_payment"]["line_end"]) == (2, 7)
    assert units["get"]["unit_type"] == "method" and units["formatCurrency"]["calls"] == ["format"]
    assert all(u["body"] for u in units.values())
    assert {r["name"] for r in index.unused_functions().collect()} == {"authenticate_user", "__init__", "generate_token", "process_payment", "fetchUserProfile", "formatCurrency", "constructor", "get", "hidden_name"} - {"get"} | {"get"}


@pytest.mark.parametrize("query,first", [("process_payment", "process_payment"), ("authenticate_user", "authenticate_user")])
def test_search_finds_the_name_first(built, query, first):
    rows = built[0].search(query).orderBy("rank").collect()
    assert rows[0]["name"] == first and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("query", ["zzz_no_such_function_name_zzz", "!@#$%^&*()", '"', "a:b:c", "\\"])
def test_odd_queries_find_nothing_and_do_not_fail(built, query):
    assert built[0].search(query).count() == 0


def test_unchanged_files_are_skipped_and_changes_followed(spark, tmp_path):
    plant(tmp_path / "repo", FILES)
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    assert index.index(str(tmp_path / "repo"), "repo") == {"indexed": 0, "skipped": 4, "removed": 0, "new_units": 0}
    plant(tmp_path / "repo", {"services/auth/login.py": "def oauth_login():\n    return refresh()\n"})
    assert index.index(str(tmp_path / "repo"), "repo") == {"indexed": 1, "skipped": 3, "removed": 0, "new_units": 1}
    assert index.search("authenticate_user").count() == 0 and index.search("oauth_login").count() == 1
    os.remove(tmp_path / "repo" / "frontend/api.ts")
    assert index.cleanup(str(tmp_path / "repo"), "repo") == {"removed_files": 1, "removed_units": 5}
    assert index.search("fetchUserProfile").count() == 0
    index.optimize()
    assert index.metadata().num_files == 3 and index.stats().first()["n_units"] == index.metadata().num_units
    assert index.rebuild(str(tmp_path / "repo"), "repo")["indexed"] == 3
    assert set(index.sizes()) >= {"units", "files", "postings"}


def test_vectors_and_similar_units(spark, tmp_path):
    plant(tmp_path / "repo", FILES)
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    hashed = lambda texts: [[float(sum(ord(c) * (k + 1) for c in t) % 97), float(len(t) % 31), 1.0] for t in texts for k in [0]]
    assert index.embed(hashed, "letters") == 12 and index.embed(hashed, "letters") == 0
    assert index.stats().first()["coverage"] == 100
    one = lambda q: hashed([q])[0]
    assert index.search("process_payment", embed=one).orderBy("rank").first()["name"] == "process_payment"
    assert index.search("anything", semantic=True, embed=one, limit=3).count() == 3
    assert index.find_similar("repo", "services/payments/processor.rs:3", 4).count() == 4
    broken = lambda q: 1 / 0
    assert index.search("process_payment", embed=broken).count() >= 1
    path = str(tmp_path / "v.bin")
    assert vector_file.write_vectors(index.table("vectors").select("unit_id", "dim", "v_min", "v_max", "data"), path) == 12
    back = vector_file.read_vectors(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, index.table("vectors").select(*back.columns).collect())) and os.path.exists(path + ".zst")
    for bad in (b"", b"XXXX" + b"\0" * 16, b"CVEC\2\0\0\0" + b"\0" * 12, b"CVEC\1\0\0\0\4\0\0\0\5\0\0\0\0\0\0\0"):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(ValueError):
            vector_file.read_header(str(tmp_path / "bad.bin"))


def test_a_broken_state_is_put_back(spark, tmp_path):
    plant(tmp_path / "repo", {"a.py": "def a():\n    return 1\n"})
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    index.optimize()
    meta = index.metadata()
    meta.checksum = "other"
    meta.save(index.metadata_path)
    with pytest.raises(RuntimeError, match="restored"):
        index.validate()
    assert index.metadata().commit == 1 and index.table("units").count() == 1
    plant(tmp_path / "repo", {"b.py": "def b():\n    return 1\n"})
    index.index(str(tmp_path / "repo"), "repo")
    index.validate(whole=True)
    other = index.table("units").withColumn("body", F.lit("x")).cache()
    other.count()
    at = f"{index.root}/{index.metadata().segments[-1]}/units"
    other.write.mode("overwrite").partitionBy("repo").parquet(at)
    index.validate()
    with pytest.raises(RuntimeError, match="restored"):
        index.validate(whole=True)


def test_a_commit_writes_what_changed(spark, tmp_path, monkeypatch):
    """Segments hold changed files only; postings, totals and checksum stay those of an index built at once."""
    from lodestone import api

    plant(tmp_path / "repo", FILES)
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    plant(tmp_path / "repo", {"pkg/__init__.py": "def seen_name():\n    return hidden_name()\n"})
    assert index.index(str(tmp_path / "repo"), "repo")["new_units"] == 1
    segments = index.metadata().segments
    assert len(segments) == 2 and spark.read.parquet(f"{index.root}/{segments[1]}/units").count() == 1
    os.remove(tmp_path / "repo" / "frontend/api.ts")
    index.index(str(tmp_path / "repo"), "repo")
    once = CodeIndex(spark, str(tmp_path / "once"))
    once.index(str(tmp_path / "repo"), "repo")
    for name in ("units", "edges", "postings"):
        assert sorted(map(str, index.table(name).collect())) == sorted(map(str, once.table(name).collect())), name
    same = lambda i: sorted((r["field"], r["n_units"], round(r["mean_length"], 9)) for r in i.field_stats().collect())
    assert same(index) == same(once) and index.metadata().checksum == once.metadata().checksum and index.metadata().num_files == 3
    assert index.search("hidden_name").count() == once.search("hidden_name").count() == 1
    assert [r["name"] for r in index.units_of_file("repo", "pkg/__init__.py").collect()] == ["seen_name"]
    first = index.pending().first()
    assert index.unit(first["id"]).first()["name"] == first["name"] and first["id"] == min(r["id"] for r in index.table("units").collect())
    assert index.with_bodies(index.search("seen_name")).first()["body"].startswith("def seen_name")
    monkeypatch.setattr(api, "MOST_SEGMENTS", 2)
    plant(tmp_path / "repo", {"n.py": "def n():\n    pass\n"})
    index.index(str(tmp_path / "repo"), "repo")
    assert len(index.metadata().segments) == 1 and index.table("units").count() == index.metadata().num_units
    # segments that neither the live nor the state before needs are gone
    assert sum(n.startswith("seg=") for n in os.listdir(index.root)) == 5


def test_a_run_that_breaks_off_leaves_the_state(spark, tmp_path, monkeypatch):
    plant(tmp_path / "repo", {"a.py": "def a():\n    return 1\n"})
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    plant(tmp_path / "repo", {"a.py": "def b():\n    return 1\n"})
    with monkeypatch.context() as m:
        m.setattr(config.Metadata, "save", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.index(str(tmp_path / "repo"), "repo")
    assert [r["name"] for r in index.table("units").collect()] == ["a"]
    assert index.index(str(tmp_path / "repo"), "repo")["indexed"] == 1
    assert [r["name"] for r in index.table("units").collect()] == ["b"]
    # a layout that is not known is built anew
    (tmp_path / "index" / "metadata.json").write_text('{"other": 1}')
    assert not index.exists() and index.index(str(tmp_path / "repo"), "repo")["indexed"] == 1


def test_watching_takes_in_changes(spark, tmp_path):
    plant(tmp_path / "repo", {"a.py": "def a():\n    return 1\n"})
    index = CodeIndex(spark, str(tmp_path / "index"))
    query = index.watch(str(tmp_path / "repo"), "repo", str(tmp_path / "ckpt"), 1)

    def wait_for(names):
        for _ in range(90):
            if query.exception():
                raise query.exception()
            if index.exists() and {r["name"] for r in index.table("units").collect()} == names:
                return
            query.awaitTermination(1)
        raise AssertionError(names)

    try:
        wait_for({"a"})
        plant(tmp_path / "repo", {"b.py": "def b():\n    return 1\n"})
        wait_for({"a", "b"})
        os.remove(tmp_path / "repo" / "a.py")
        wait_for({"b"})
    finally:
        query.stop()


def test_given_paths_only(spark, tmp_path):
    plant(tmp_path / "repo", {"a.py": "def a():\n    return 1\n", "x/b.py": "def b():\n    return 1\n", ".gitignore": "no/\n", "no/c.py": "def c(): pass\n"})
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    plant(tmp_path / "repo", {"a.py": "def a2():\n    return 1\n", "x/b.py": "def b2():\n    return 1\n"})
    assert index.update_paths(str(tmp_path / "repo"), "repo", ["a.py", "no/c.py", "gone.py", "a.py"])["indexed"] == 1
    assert {r["name"] for r in index.table("units").collect()} == {"a2", "b"}
    os.remove(tmp_path / "repo" / "x/b.py")
    assert index.update_paths(str(tmp_path / "repo"), "repo", ["x/b.py"])["removed"] == 1


def test_tree_rules(spark, tmp_path):
    plant(
        tmp_path,
        {
            ".gitignore": "ignored/\n*.skip.py\n!keep.skip.py\n/top.py\n", ".lodestoneignore": "own_*.py\n", "a.py": "x = 1\n", "ignored/b.py": "x\n", "c.skip.py": "x\n", "keep.skip.py": "x\n", "top.py": "x\n", "sub/top.py": "x\n", "own_a.py": "x\n",
            "sub/.gitignore": "deep/**/x.py\n", "sub/deep/q/x.py": "x\n", "sub/deep/q/y.py": "x\n", ".hidden/a.py": "x\n", "__pycache__/a.py": "x\n", "dist-esm/a.js": "x\n", "a.d.ts": "x\n", "b.pb.go": "x\n", "readme.md": "x\n", "empty.py": "",
            "gen.go": "// Code generated by x\npackage a\n", "long.js": "x" * 600, "nul.py": b"a\0b", "bad.py": b"\xff\xfe", "late_bad.py": b"x = 1\n" * 100 + b"\xff", "_private.py": "x\n", "__init__.py": "x\n", "one/two/three/four.py": "x\n",
        },
    )
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    got = {r["file_path"] for r in tree.read_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"a.py", "keep.skip.py", "sub/top.py", "sub/deep/q/y.py", "_private.py", "__init__.py", "one/two/three/four.py"}


def test_line_cap_and_unknown_languages():
    assert parse.parse_text("def f():\n    pass\n" * 6000, "python") == []
    assert parse.parse_text("def f(): pass", "unknown") == []
    assert [u.name for u in parse.parse_text("def f(:\n    g(1)\n\nclass C:\n    def m(self):\n        return 2\n", "python")] == ["f", "C", "m"]


SOURCES = [
    ("go", 'package x\ntype A struct { x int }\ntype B interface { F() }\ntype C int\nfunc Do(a int) (int, error) { return help(a), fmt.Errorf("x {") }\nfunc (a *A) M() { a.n() }\n', [("struct", "A"), ("interface", "B"), ("type", "C"), ("function", "Do"), ("method", "M")]),
    ("java", "class Foo extends Bar {\n  Foo(int x) { this.x = x; obj.run(); }\n  static <T> List<T> list(T a) throws E { return helper(a); }\n  interface I { void f(); }\n  enum E { A }\n}\n", [("class", "Foo"), ("method", "Foo"), ("method", "list"), ("interface", "I"), ("method", "f"), ("enum", "E")]),
    ("cpp", "namespace n {\nclass Foo { int x; };\nint Foo::bar(int x) const { return baz(x); }\n}\nstatic int main2(int a) { if (a) { return f(a); } return 1; }\n", [("class", "Foo"), ("function", "Foo::bar"), ("function", "main2")]),
    ("rust", "struct P(i32);\nimpl P { fn go(&self) { help::me() } }\ntrait T { fn y(&self) { a() } }\nenum E { A }\n", [("struct", "P"), ("function", "go"), ("trait", "T"), ("enum", "E")]),
]


@pytest.mark.parametrize("language,text,expected", SOURCES)
def test_other_languages(language, text, expected):
    assert [(u.unit_type, u.name) for u in parse.parse_text(text, language)] == expected


def test_changes(spark):
    schema = "repo string, file_path string, file_hash string"
    now = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", None)], schema)
    was = spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "c", None), ("r", "d", "4")], schema)
    assert {r["file_path"]: r["change"] for r in changes.classify(now, was).collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "deleted"}
    assert [r["file_path"] for r in changes.missing_files(was, now).collect()] == ["d"]
    assert changes.upsert_files(was, now).count() == 4
    one, two = changes.table_checksum(now).first(), changes.table_checksum(now.repartition(3)).first()
    assert one == two and one != changes.table_checksum(was).first()


def test_debounce(spark):
    rows = spark.createDataFrame([("r", f"2025-01-01 00:00:{s:02d}", i) for i, s in enumerate([0, 1, 2, 10, 11, 40])], "repo string, at string, event_id int").selectExpr("repo", "timestamp(at) AS at", "event_id")
    assert [r["batch"] for r in watch.debounced(rows, "repo", "at", 5).orderBy("at").collect()] == [1, 1, 1, 2, 2, 3]
    assert [r["stretch"] for r in watch.debounced(rows, "repo", "at", 5, 2).orderBy("at").collect()] == [0, 0, 1, 0, 0, 0]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.23456, 'na"me', "function", "go", "a,b.go", 3, 9, None, None, "f()\nx")], "rank int, score double, name string, unit_type string, language string, file_path string, line_start int, line_end int, signature string, docstring string, snippet string")
    got = json.loads(sinks.to_json_rows(rows).first()["json"])
    assert list(got) == sinks.JSON_KEYS and got["signature"] is None
    assert sinks.to_csv_rows(rows).first()["csv"] == '1,1.2346,"na""me",function,go,"a,b.go",3'
    assert sinks.to_plain_rows(rows).first()["text"] == 'a,b.go:3  na"me  function · go\n  f()'
    assert "\x1b[36m" in sinks.to_plain_rows(rows, colour=True).first()["text"]
    for kind in ("json", "csv", "plain"):
        sinks.write_results(rows, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == sinks.CSV_COLUMNS
    with pytest.raises(ValueError):
        sinks.write_results(rows, str(tmp_path / "x"), "xml")


def test_config_registry_metadata_and_lock(tmp_path):
    path = str(tmp_path / "c.toml")
    own = config.Config.load(path)
    own.set("search.limit", "25")
    own.set("search.exclude_tests", "yes")
    own.set("search.format", "json")
    own.set("editor.command", "auto")
    own.save(path)
    again = config.Config.load(path)
    assert again.get("search.limit") == "25" and again.get("search.exclude_tests") == "true" and again.get("search.format") == "json" and again.get("editor.command") == "(auto-detect)" and len(again.list()) == 6
    for key, value in (("search.limit", "many"), ("search.format", "xml"), ("search.no_tui", "perhaps")):
        with pytest.raises(ValueError):
            own.set(key, value)
    with pytest.raises(KeyError):
        own.get("no.key")
    (tmp_path / "c.toml").write_text("[[broken")
    assert config.Config.load(path) == config.Config()
    registry = config.Registry(str(tmp_path / "r.json"))
    registry.add("a", "/a", 1)
    registry.add("b", "/b", 2)
    with pytest.raises(ValueError):
        registry.add("a", "/c", 3)
    assert [r.path for r in config.Registry(registry.path).resolve("b, a")] == ["/b", "/a"]
    with pytest.raises(KeyError):
        registry.resolve("a,missing")
    assert registry.remove("a") and not registry.remove("a")
    meta = config.Metadata(version=config.VERSION + 1)
    with pytest.raises(RuntimeError):
        meta.migrate()
    assert config.Metadata(version=0).migrate() and not config.Metadata().migrate()
    with config.Lock(str(tmp_path / "lock")), pytest.raises(RuntimeError), config.Lock(str(tmp_path / "lock")):
        pass
    with config.Lock(str(tmp_path / "lock")):
        pass
    with config.Lock(str(tmp_path / "lock"), shared=True), config.Lock(str(tmp_path / "lock"), shared=True), pytest.raises(config.Locked), config.Lock(str(tmp_path / "lock")):
        pass
    with config.Lock(str(tmp_path / "lock")), pytest.raises(config.Locked), config.Lock(str(tmp_path / "lock"), shared=True):
        pass
    import socket

    (tmp_path / "lock").write_text(f"{socket.gethostname()} 999999999")
    with config.Lock(str(tmp_path / "lock")):  # of a dead process of this host
        pass
    (tmp_path / "lock").write_text("another-host 1")
    with pytest.raises(config.Locked), config.Lock(str(tmp_path / "lock")):
        pass


def test_sources_of_events_and_hooks(tmp_path):
    plant(tmp_path, {"a.py": "x = 1\n"})
    with pytest.raises(ValueError):
        events.TreeEventReader(str(tmp_path), "other")
    with pytest.raises(FileNotFoundError):
        events.TreeEventReader(str(tmp_path), "git")
    (tmp_path / ".git").mkdir()
    mine = tmp_path / ".git" / "hooks" / "post-commit"
    mine.parent.mkdir()
    mine.write_text("#!/bin/sh\nmake check\n")
    assert len(events.install_hooks(str(tmp_path))) == len(events.install_hooks(str(tmp_path))) == 4
    assert mine.read_text().count("lodestone-changed") == 1 and os.access(mine, os.X_OK)
    reader = events.TreeEventReader(str(tmp_path), "git")
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [(None, True)]
    plant(tmp_path, {"b.py": "y = 1\n"})
    rows, at = reader.read(at)
    assert list(rows) == []
    (tmp_path / ".git" / events.MARK).write_text("")
    assert list(reader.read(at)[0]) == [(None, True)]
    events.remove_hooks(str(tmp_path))
    assert mine.read_text() == "#!/bin/sh\nmake check\n" and len(list(mine.parent.iterdir())) == 1


def test_the_users_ignore_file(spark, tmp_path, monkeypatch):
    plant(tmp_path, {"conf/git/ignore": "*.old.py\nkept.old.py\n", "repo/a.py": "x\n", "repo/b.old.py": "x\n", "repo/kept.old.py": "x\n", "repo/.gitignore": "!kept.old.py\n"})
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    root = str(tmp_path / "repo")
    folders, files, _ = tree.entries(root, root, [])
    assert [os.path.basename(f) for f in files] == ["a.py", "kept.old.py"] and not folders


def test_daemon(spark, tmp_path):
    plant(tmp_path / "repo", {"a.py": "def a():\n    return 1\n"})
    daemon = Daemon(CodeIndex(spark, str(tmp_path / "index")))
    os.makedirs(tmp_path / "index")
    assert daemon.status() == "stopped" and not daemon.stop()
    (tmp_path / "index" / "daemon.json").write_text(json.dumps({"host": __import__("socket").gethostname(), "pid": 999999999, "started_at": 1, "path": "x", "repo": "r", "query": "q"}))
    assert daemon.status() == "stale"
    state = daemon.start(str(tmp_path / "repo"), "repo", 1)
    try:
        assert daemon.status() == "running" and daemon.state() == state
        with pytest.raises(RuntimeError):
            daemon.start(str(tmp_path / "repo"), "repo")
    finally:
        assert daemon.stop()
    assert daemon.status() == "stopped"


def test_vectors_are_made_when_they_are_needed(spark, tmp_path):
    plant(tmp_path / "repo", FILES)
    index = CodeIndex(spark, str(tmp_path / "index"))
    index.index(str(tmp_path / "repo"), "repo")
    assert index.search_lazily("charge_card", "tokens-16", 2).orderBy("rank").first()["name"] == "charge_card"
    some = index.table("vectors").count()
    assert 0 < some < 12 and index.pending().count() == 12 - some
    index.search_lazily("charge_card", "tokens-16", 2)
    assert index.table("vectors").count() == some
    assert index.embed_with("tokens-16") == 12 - some and index.pending().count() == 0
    assert {r["embedding_model"] for r in index.table("units").collect()} == {"tokens-16"}
