"""Workspace search, recent list, source files and the registry."""

from pyspark.sql import functions as F

from strandline.functions import display as D
from strandline.functions import text as X
from strandline.sources import workspace as W


def touch(base, *names):
    for n in names:
        p = base / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")


def names(spark, path):
    return [r["path"].rsplit("/", 1)[1] for r in W.find_candidates(spark, str(path)).collect()]


def test_candidates(spark, tmp_path):
    touch(tmp_path, "a/App.sln", "a/App.slnx", "a/src/Lib.csproj", "b/One/One.csproj", "b/bin/No.csproj", "b/.hid/No.csproj", "c/d/e/f/g/Deep.csproj")
    assert names(spark, tmp_path / "a") == ["App.slnx", "App.sln"]
    assert names(spark, tmp_path / "b") == ["One.csproj"]
    assert names(spark, tmp_path / "c") == [] and names(spark, tmp_path / "gone") == []
    assert W.resolve(spark, str(tmp_path / "a" / "App.sln")).endswith("App.sln")
    touch(tmp_path, "n.txt")
    assert names(spark, tmp_path / "n.txt") == []


def test_listing_prunes_before_it_lists(spark, tmp_path, monkeypatch):
    touch(tmp_path, "App/A.csproj", "App/notes.txt", "Node_Modules/x/No.csproj", ".cache/x/No.csproj", "BIN/No.csproj", "s/All.SLN", "s/src/In.csproj", "a/b/c/Low.csproj", "a/b/c/d/Lower.csproj", "odd [x] {y}/E,é.CSPROJ")
    place, listed = W._place, []

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def listStatus(self, path):
            listed.append(path.toUri().getPath().removeprefix(str(tmp_path)))
            return self.fs.listStatus(path)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(W, "_place", lambda s, p: (Watched(place(s, p)[0]), place(s, p)[1]))
    assert sorted(names(spark, tmp_path)) == ["A.csproj", "All.SLN", "E,é.CSPROJ", "Low.csproj"]
    assert sorted(listed) == ["", "/App", "/a", "/a/b", "/a/b/c", "/odd [x] {y}", "/s"]


def test_other_file_systems(spark, tmp_path):
    """The same candidates by a path that only Hadoop reads, spelled as it was asked for; stores that aren't there give nothing."""
    touch(tmp_path, "p/One.csproj", "q/Two.sln", "q/deep/Three.csproj")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./w", f"file://{tmp_path}")
    found = [r["path"] for r in W.find_candidates(spark, "viewfs://shelf/w").collect()]
    assert found == ["viewfs://shelf/w/q/Two.sln", "viewfs://shelf/w/p/One.csproj"]
    assert [r["path"] for r in W.find_candidates(spark, str(tmp_path)).collect()] == [f.replace("viewfs://shelf/w", str(tmp_path)) for f in found]
    assert W.resolve(spark, "viewfs://shelf/w/p/One.csproj") == found[1] and W.source_text(spark, found[1]) == "x"
    for gone in ("viewfs://shelf/w/none", "viewfs://nowhere/w", "nosuch://x/y"):
        assert W.find_candidates(spark, gone).collect() == []


def test_recent_list(tmp_path):
    touch(tmp_path, *[f"p{i}" for i in range(12)])
    r = W.RecentList(str(tmp_path / "x" / "recent.json"))
    for i in range(12):
        r.add(str(tmp_path / f"p{i}"))
    assert len(r.load()) == 10 and r.load()[0].endswith("p11")
    (tmp_path / "x" / "recent.json").write_text("{")
    assert r.load() == []


def test_source_text(spark, tmp_path):
    touch(tmp_path, "a.cs")
    (tmp_path / "big.cs").write_text("y" * (4 * 1024 * 1024 + 1))
    assert W.source_text(spark, str(tmp_path / "a.cs")) == "x"
    assert W.source_text(spark, str(tmp_path / "big.cs")).startswith("//") and W.source_text(spark, str(tmp_path / "no.cs")) is None


def test_display(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert get(D.authorization_summary(F.lit(True), F.lit(True), a("p"), a())) == "Anonymous"
    assert get(D.authorization_summary(F.lit(False), F.lit(True), a(), a("r", "s"))) == "r, s"
    assert get(D.authorization_summary(F.lit(False), F.lit(False), a("p"), a())) == ""
    assert get(X.join_list(X.split_list(F.lit("a, b,,c d")))) == "a, b, c d"
    assert get(D.origin(F.lit("/x/y.cs"), F.lit(None))) == "y.cs:?" and get(D.origin(F.lit(None), F.lit(1))) == ""
    assert get(D.breadcrumb(F.lit("/o/a.cs"), F.lit("/w"))).endswith("a.cs")
    assert get(D.editor_command(F.lit("vi +{line}"), F.lit("f.cs"), F.lit(None).cast("int"))) == "vi +1 f.cs"


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 40
    assert e.queries()["projects_with_counts"](spark, "/root/testdata/sf0.001").count() == 25
