import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quillmill.sources import checkout, documents, files, gitlog
from quillmill.streaming import usage


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".secret").mkdir()
    for name, data in {"essay.txt": b"hello\r\nyou", "sub/notes.md": b"not\xe9", "scan.png": b"\x89PNG", "ignored.exe": b"x", "empty.txt": b"  ", ".secret/p.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    samples, binary = files.load(spark, str(tmp_path))
    assert {r["origin"]: r["text"] for r in samples.collect()} == {"essay.txt": "hello\nyou", "notes.md": "not\ufffd"}
    assert [(r["filename"], r["mimetype"]) for r in binary.collect()] == [("scan.png", "image/png")]
    assert files.expand(spark, str(tmp_path), 2).count() == 2
    rows = files.load_triaged(spark, [str(tmp_path), str(tmp_path / "essay.txt")]).collect()
    assert sorted(r["origin"] for r in rows) == ["essay.txt", "notes.md", "scan.png"] and len({r["pos"] for r in rows}) == 3
    for bad in ("nowhere", "ignored.exe", ".secret"):
        with pytest.raises(files.SourceError):
            files.expand(spark, str(tmp_path / bad))


def test_log_and_blame(spark):
    raw = "sha1\x1fa@x\x1fAl\x1fsubject\n\nbody\x1ebad record\x1e\nsha2\x1fb@x\x1fBo\x1ftext\x1e"
    got = gitlog.parse_log(spark.createDataFrame([(raw,)], "raw string")).collect()
    assert [(r["sha"].strip(), r["email"]) for r in got] == [("sha1", "a@x"), ("sha2", "b@x")]
    lines = ["abc 1 1", "author-mail <a@x>", "\tone", "def 2 2", "\ttwo", "author-mail <not.committed.yet>", "\tthree"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "path string, pos int, line string")
    assert [(r["line_no"], r["author"]) for r in gitlog.parse_blame(df, "me@x").orderBy("line_no").collect()] == [(1, "a@x"), (2, "a@x"), (3, "me@x")]


def test_usage_stream(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 10:00:00", "u", "aux"), ("2024-01-01 11:00:00", "u", "aux"), ("2024-01-02 10:00:00", "v", "persona")], "s string, user string, op string").withColumn("ts", F.to_timestamp("s")).drop("s")
    src.write.parquet(str(tmp_path / "in"))
    stream = usage.usage_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("usage_rows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["user"], r["op"], r["n"]) for r in spark.table("usage_rows").collect()) == [("u", "aux", 2), ("v", "persona", 1)]


def test_checkout(spark, tmp_path):
    repo = str(tmp_path / "r")
    os.mkdir(repo)
    assert not checkout.is_git_repo(repo) and checkout.tracked_files(repo) == []
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.email=me@x.org", "-c", "user.name=Me", *a], check=True, capture_output=True)
    git("init", "-q")
    for name, data in {"a b+c.md": b"one\ntwo\n", "bin.md": b"x\x00y", "big.md": b"z" * 1_000_001, "odd.md": b"caf\xe9"}.items():
        with open(f"{repo}/{name}", "wb") as f:
            f.write(data)
    os.symlink("/etc/hostname", f"{repo}/link.md")
    git("add", "-A")
    git("commit", "-qm", "Explain the reason\n\nbody")
    with open(f"{repo}/not-tracked.md", "w") as f:
        f.write("no")
    assert checkout.is_git_repo(repo) and "link.md" in checkout.tracked_files(repo)
    assert [checkout.safe_path(repo, n) for n in ("link.md", "/etc/passwd", "../x", "", "big.md", "none")] == [None] * 6
    assert {r["path"]: r["text"] for r in checkout.repository_files(spark, repo).collect()} == {"a b+c.md": "one\ntwo\n", "odd.md": "caf\ufffd"}
    assert [(r["email"], r["body"].strip()) for r in checkout.commits(spark, repo).collect()] == [("me@x.org", "Explain the reason\n\nbody")]
    assert checkout.commits(spark, repo, "you@x.org").count() == 0
    assert [(r["line_no"], r["author"]) for r in checkout.blame(spark, repo, ["a b+c.md", "none"]).orderBy("line_no").collect()] == [(1, "me@x.org"), (2, "me@x.org")]
    log, changed = checkout.history(spark, repo, ["a b+c.md", "not-tracked.md"])
    assert [r["author"] for r in log.collect()] == ["me@x.org"] and [r["path"] for r in changed.collect()] == ["not-tracked.md"]


def test_documents(tmp_path):
    first = documents.write_document(str(tmp_path / "AGENTS.md"), "text", header="head")
    assert open(first).read() == "head\n\ntext"
    second = documents.write_document(str(tmp_path / "AGENTS.md"), "new", header="head")
    assert second.endswith("AGENTS-new.md") and open(first).read() == "head\n\ntext"
    assert open(documents.write_document(first, "new", replace=True)).read() == "\n\nnew"
    assert open(documents.write_document(str(tmp_path / "me.md"), "text", header="head")).read() == "text"


def make_repo(folder, who, files, message="Explain the reason in a sentence that is long enough to keep"):
    os.makedirs(folder)
    git = lambda *a: subprocess.run(["git", "-C", folder, "-c", f"user.email={who}", "-c", "user.name=N", *a], check=True, capture_output=True)
    git("init", "-q")
    git("config", "user.email", who)
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(data)
    git("add", "-A")
    git("commit", "-qm", message)
    return folder


def test_many_checkouts(spark, tmp_path, monkeypatch):
    from quillmill.operators import repository
    from quillmill.sources import git_calls, git_source

    prose = "I wrote this note because the first version did not say why we do it that way, and someone asked."
    reviews = '[{"number": 7, "title": "t", "body": "' + prose + '", "author": {"login": "al"}, "comments": []}]'
    repos = [make_repo(str(tmp_path / f"r{i}"), f"al{i}@x.org", {f"f{j}.md": f"{prose} {i} {j}\nsecond\n" for j in range(5)} | {"export.json": reviews}, f"{prose} number {i}") for i in range(3)]
    os.mkdir(tmp_path / "plain")
    listed = [*repos, str(tmp_path / "plain"), str(tmp_path / "nowhere")]
    monkeypatch.setattr(git_calls.subprocess, "run", None)  # no git on the driver
    table = lambda name, **o: git_source.read(spark, listed, name, **o)
    files = table("files", shares=2)
    assert files.rdd.getNumPartitions() == 10
    assert sorted((r["repo"], r["path"]) for r in files.where("path like '%.md'").collect()) == sorted((repo, f"f{j}.md") for repo in repos for j in range(5))
    assert sorted((r["repo"], r["email"], r["pos"]) for r in table("log").collect()) == [(repo, f"al{i}@x.org", 0) for i, repo in enumerate(repos)]
    assert table("log", author="al1@x.org").count() == 1 and table("log", most=0).count() == 0
    blame = table("blame", shares=3).where("path = 'f2.md'").collect()
    assert sorted((r["repo"], r["line_no"], r["author"]) for r in blame) == [(repo, n, f"al{i}@x.org") for i, repo in enumerate(repos) for n in (1, 2)]
    assert table("history", paths=["f1.md", "none"]).count() == 3
    with open(f"{repos[0]}/f1.md", "a") as f:
        f.write("new line\n")
    open(f"{repos[1]}/ü new.md", "w").close()
    assert sorted((r["repo"], r["path"]) for r in table("changes").collect()) == [(repos[0], "f1.md"), (repos[1], "ü new.md")]
    assert [r["author"] for r in table("blame", paths=["f1.md"]).where(f"repo = '{repos[0]}'").orderBy("line_no").collect()] == ["al0@x.org"] * 3
    exported = table("reviews", export="export.json")
    assert exported.count() == 3 and table("reviews").count() == 0  # no tool and no remote: nothing
    assert [r["text"] for r in repository.mine_prs(exported, [], order="repo").collect()] == [prose] * 3
    mined = repository.mine_all([repository.mine_commits(table("log").drop("repo")), repository.mine_docs(files.select("path", "text"))])
    assert {r["kind"]: r["count"] for r in mined.groupBy("kind").count().collect()} == {"commit": 3, "doc": 15}
    with pytest.raises(Exception, match="table"):
        git_source.read(spark, listed, "wrong").count()
