import json
import subprocess

import pytest

from recordloom import cli
from recordloom.errors import ReferenceError_, TransactionError
from recordloom.operators.check import Abort, abortable, check_file, fix_file
from recordloom.plans import config as cfg
from recordloom.sources import gitrepo
from recordloom.store import Store


@pytest.fixture
def call(spark, tmp_path, capsys):
    def run(*argv):
        capsys.readouterr()
        code = cli.run(spark, ["--store", str(tmp_path / "s"), *argv])
        out = capsys.readouterr()
        return code, out.out, out.err

    return run


def lines(text):
    return [json.loads(x) for x in text.splitlines()]


def test_a_session(call, tmp_path):
    assert call("init", "repos", "--path", "${{ name }}")[0] == 0
    rows = [{"name": n, "status": s, "size": k, "team": t} for n, s, k, t in (("a", "x", 3, "slate"), ("b", "y", 1, None), ("c", "y", 2, "sencha"))]
    code, out, _ = call("upsert", "repos", "--data", json.dumps([{k: v for k, v in r.items() if v is not None} for r in rows]))
    assert code == 0 and lines(out) == [{"category": "insert", "count": 3}]
    assert lines(call("count", "repos", "--filter", "status=y")[1]) == [{"count": 2, "of": 3}]
    code, out, err = call("query", "repos", "--filter", "size>1", "--sort", "size", "--fields", "name,size")
    assert lines(out) == [{"name": "c", "size": 2}, {"name": "a", "size": 3}] and err.strip() == "2 of 2 total"
    assert lines(call("query", "repos", "--group-by", "team")[1])[0] == {"count": 1, "value": ""}
    assert call("query", "repos", "--fields", "name", "--format", "csv", "--limit", "1")[1] == "name\na\n"
    assert [r["value"] for r in lines(call("distinct", "repos", "status")[1])] == ["x", "y"]
    assert lines(call("read", "repos", "a")[1])[0]["team"] == "slate" and call("read", "repos", "zz")[0] == 67
    assert lines(call("upsert", "repos", "--dry-run", "--data", '{"name": "a", "status": "new", "size": 3, "team": "slate"}')[1]) == [{"category": "changed", "count": 1}]
    assert call("patch", "repos", "--data", '{"name": "b", "team": "ops"}')[0] == 0
    assert call("patch", "repos", "--data", '{"name": "zz", "team": "ops"}')[0] == 67
    assert lines(call("query", "repos", "--filter", "team=ops", "--fields", "name")[1]) == [{"name": "b"}]
    assert call("rename", "repos", "b", "bee")[0] == 0 and lines(call("delete", "repos", "--filter", "name=c")[1]) == [{"deleted": 1}]
    assert call("delete", "repos")[0] == 22 and call("query", "repos", "--filter", "garbage")[0] == 22
    log = lines(call("log")[1])
    assert len(log) == 5
    first = log[-2]["id"]
    code, out, err = call("diff", "repos", first, "--patches")
    assert {d["status"] for d in lines(out)} == {"added", "deleted"} and "changes" in err
    schema = lines(call("infer", "repos", "--write")[1])[0]
    assert schema["properties"]["size"]["type"] == "integer" and lines(call("view", "repos")[1])[0]["records"] == 2
    assert call("upsert", "repos", "--data", '{"name": "q", "size": 99}')[0] == 22
    assert lines(call("query", "repos", "--export", str(tmp_path / "o.json"))[1])[0]["exported"] == 2
    assert lines(call("sheets")[1]) == [{"name": "repos", "format": "toml", "records": 2, "root": "."}] and call("view", "none")[0] == 64
    (tmp_path / "x.txt").write_text("hi")
    assert call("attachment", "repos", "set", "a", "--file", str(tmp_path / "x.txt"))[0] == 0
    assert lines(call("attachment", "repos", "list", "a")[1])[0]["size"] == 2
    assert call("attachment", "repos", "get", "a", "--name", "x.txt", "--out", str(tmp_path / "y"))[0] == 0 and (tmp_path / "y").read_text() == "hi"
    assert call("attachment", "repos", "delete", "a")[0] == 0
    (tmp_path / "c.json").write_text('{"$id": "https://x.org/r", "required": ["name"]}')
    assert call("contracts", "adopt", "--name", "x.org/r", "--document", str(tmp_path / "c.json"), "--sheet-name", "repos")[0] == 0
    assert lines(call("contracts", "list")[1]) == [["x.org/r"]] and call("contracts", "sync", "--name", "x.org/r", "--document", str(tmp_path / "c.json"))[0] == 0
    assert lines(call("contracts", "verify", "--name", "x.org/r", "--sheet-name", "repos")[1])[0]["rung"] == "declared"
    assert call("contracts", "prune")[1].strip() == "[]" and "$id" in call("contracts", "export", "--name", "x.org/r")[1]
    assert call("normalize", "repos")[1].strip() == '{"changed": 0}' and call("migrate-config", "repos")[0] == 0


def test_check_files(tmp_path):
    config = cfg.from_table("s", {"path": "${{ a }}", "schema": {"required": ["a"]}, "fields": {"t": {"sort": True}}})
    assert check_file('a = 1\nt = ["x", "y"]\n', config).exit_code == 0
    assert check_file("b = 1\n", config).exit_code == 22 and check_file("a = ", config).exit_code == 64
    path = tmp_path / "r.toml"
    path.write_text('t = ["y", "x"]\na = 1\n')
    assert check_file(path.read_text(), config).exit_code == 1
    assert fix_file(str(path), config).exit_code == 0 and path.read_text() == 'a = 1\nt = ["x", "y"]\n'


def test_writes_without_a_transaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with store.transact() as tx:
        tx.write_config("u", {"path": "${{ k }}"})
    sheet = store.sheet("u")
    sheet.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"))
    assert sheet.query().count() == 2 and sheet.path_for({"k": "z"}) == "z" and store.drift() == {}
    assert [tuple(r) for r in sheet.will_change(spark.createDataFrame([("a", 1), ("c", 3)], "k string, n int")).orderBy("_path").collect()] == [("a", "no-op"), ("c", "insert")]
    sheet.patch({"k": "a"}, {"n": 5})
    sheet.delete("b")
    assert [(r.k, r.n) for r in sheet.query().collect()] == [("a", 5)]
    sheet.clear()
    assert sheet.query().count() == 0
    strict = Store(spark, store.root, strict=True)
    with pytest.raises(TransactionError):
        strict.sheet("u").clear()


def test_abort(spark):
    with abortable(spark) as a:
        assert isinstance(a, Abort) and a.tag in spark.getTags()
        a.abort()
        with pytest.raises(Exception, match="aborted"):
            a.check()
    assert a.tag not in spark.getTags()


def test_git(spark, tmp_path):
    repo = tmp_path / "g"
    (repo / "people" / "x").mkdir(parents=True)
    (repo / ".sheets").mkdir()
    git = lambda *c: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *c], check=True, capture_output=True)
    git("init", "-q")
    (repo / "people" / "x" / "a.toml").write_text("n = 1\n")
    (repo / "people" / "é b.toml").write_text("n = 2\n")
    (repo / ".sheets" / "people.toml").write_text("n = 3\n")
    (repo / "post.md").write_text("+++\nn = 4\n+++\n\nBody\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("tag", "v1")
    (repo / "people" / "x" / "a.toml").write_text("n = 10\n")
    git("commit", "-qam", "two")
    found = {r._path: json.loads(r.document)["n"] for r in gitrepo.read(spark, str(repo), base="people").collect()}
    assert found == {"x/a": 10, "é b": 2}
    assert {json.loads(r.document)["n"] for r in gitrepo.read(spark, str(repo), "v1", "people").collect()} == {1, 2}
    assert [r._path for r in gitrepo.blobs(spark, str(repo)).orderBy("_path").collect()] == ["people/x/a", "people/é b"]
    assert gitrepo.read(spark, str(repo), format="markdown").first().body == "Body\n"
    row = gitrepo.blobs(spark, str(repo), "v1", "people/x").first()
    assert row._blob == subprocess.run(["git", "hash-object", "--stdin"], input=b"n = 1\n", capture_output=True).stdout.decode().strip()
    with pytest.raises(ReferenceError_):
        gitrepo.resolve(str(repo), "nothing")
