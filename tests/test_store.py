import json
import pytest
from pyspark.sql import functions as F

from recordloom.errors import ConfigError, ContractError, IndexError_, NotFoundError, ReferenceError_, TransactionError, ValidationError
from recordloom.plans import contracts
from recordloom.store import Snapshot, Store, check_trailers

USERS = [("jane", "jane@x.org", "eng"), ("bob", "bob@x.org", "eng"), ("mia", "mia@x.org", "ops")]
FIELDS = "slug string, email string, team string"
TABLE = {"path": "${{ slug }}", "schema": {"required": ["email", "slug"], "type": "object"}}


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    with s.transact("Start", trailers={"Ticket": "7"}) as tx:
        tx.write_config("users", TABLE)
        tx.upsert("users", spark.createDataFrame(USERS, FIELDS))
    return s


def slugs(df):
    return [r.slug for r in df.collect()]


def test_commits_and_reads(spark, store):
    sheet = store.sheet("users")
    assert slugs(sheet.query()) == ["bob", "jane", "mia"] and slugs(sheet.query({"team": "eng"})) == ["bob", "jane"] and slugs(sheet.where(["team=ops"])) == ["mia"]
    assert sheet.query_first({"team": "eng"})["slug"] == "bob" and sheet.query_first({"team": "none"}) is None
    c = store.commit("main")
    assert c.text() == "Start\n\nTicket: 7" and c.parent is None and store.summary() == [{"name": "users", "format": "toml", "records": 3, "root": "."}]
    assert sheet.describe()["properties"] == {} and [r._path for r in sheet.candidate_paths({}).collect()] == ["bob", "jane", "mia"]
    with pytest.raises(ReferenceError_):
        store.commit("nothing")
    with pytest.raises(ConfigError):
        store.sheet("none")


def test_no_op_and_time_travel(spark, store):
    first = store.head
    with store.transact() as tx:
        report = tx.upsert("users", spark.createDataFrame(USERS[:2], FIELDS))
    assert {tuple(r) for r in report.collect()} == {("no-op", 2)} and tx.result is None and store.head == first
    with store.transact("Change") as tx:
        tx.upsert("users", spark.createDataFrame([("bob", "b@x.org", "ops"), ("new", "n@x.org", None)], FIELDS))
    assert tx.result.parent == first and len(list(store.log())) == 2
    assert store.sheet("users", first).query({"slug": "bob"}).first().email == "bob@x.org"
    assert {(r.path, r.status) for r in store.diff("users", first).collect()} == {("bob", "modified"), ("new", "added")}
    assert {r.status for r in store.diff("users", None).collect()} == {"added"}
    with store.transact("Back") as tx:
        tx.upsert("users", spark.createDataFrame(USERS, FIELDS), delete_missing=True)
    assert store.diff("users", first).count() == 0


def test_failures_change_nothing(spark, store):
    head = store.head
    with pytest.raises(ValidationError), store.transact() as tx:
        tx.upsert("users", spark.createDataFrame([("x", None, None)], FIELDS))
    with pytest.raises(RuntimeError), store.transact() as tx:
        tx.clear("users")
        raise RuntimeError
    with pytest.raises(TransactionError) as e, store.transact():
        with store.transact():
            pass
    assert e.value.code == "transaction_in_progress" and store.head == head and store.sheet("users").query().count() == 3
    with store.transact() as tx:
        pass
    with pytest.raises(TransactionError):
        tx.clear("users")
    with store.lock(), pytest.raises(TransactionError) as e:
        with store.lock():
            pass
    assert e.value.code == "lock_held"


def test_moved_parent(spark, store):
    other = Store(spark, store.root)
    with pytest.raises(TransactionError) as e, store.transact() as tx:
        tx.clear("users")
        Store._active.discard(store.root)
        with other.transact() as inner:
            inner.delete_where("users", ["slug=mia"])
    assert e.value.code == "parent_moved"
    assert store.sheet("users").query().count() == 3
    store.refresh()
    assert store.sheet("users").query().count() == 2


def test_patch_delete_rename_normalize(spark, store):
    with store.transact() as tx:
        assert tx.patch("users", {"team": "eng"}, {"email": "new@x.org", "team": None}) == "bob"
        tx.rename("users", "mia", "mina")
        tx.delete("users", "jane")
    rows = {r.slug: r for r in store.sheet("users").query().collect()}
    assert set(rows) == {"bob", "mina"} and rows["bob"].email == "new@x.org" and rows["bob"].team is None
    with store.transact() as tx:
        with pytest.raises(NotFoundError):
            tx.delete("users", "jane")
        with pytest.raises(NotFoundError):
            tx.patch("users", {"slug": "who"}, {"team": "x"})
        assert tx.delete_where("users", ["slug=none"]) == 0
        tx.patch("users", {"slug": "mina"}, {"slug": "min"})
        tx.bulk_patch("users", spark.createDataFrame([("bob", "z")], "slug string, team string"))
    assert sorted(slugs(store.sheet("users").query())) == ["bob", "min"] and store.sheet("users").query({"slug": "bob"}).first().team == "z"
    with store.transact() as tx:
        tx.write_config("tags", {"path": "${{ id }}", "fields": {"tags": {"sort": True}}})
        tx.stage("tags", spark.createDataFrame([("a", ["b10", "b9"], "a")], "id string, tags array<string>, _path string"))
    with store.transact() as tx:
        assert tx.normalize("tags") == 1 and tx.normalize("tags") == 0
    assert store.sheet("tags").query().first().tags == ["b9", "b10"]


def test_partitions_prune(spark, tmp_path):
    s = Store(spark, str(tmp_path / "p"))
    with s.transact() as tx:
        tx.write_config("people", {"path": "${{ domain }}/${{ name }}"})
        tx.upsert("people", spark.createDataFrame([("01", "a"), ("02", "b"), ("02", "c")], "domain string, name string"))
    found = s.sheet("people").query({"domain": "02"})
    assert [r.name for r in found.collect()] == ["b", "c"] and "_p0" not in found.columns
    assert "PartitionFilters: [isnotnull(_p0" in found._jdf.queryExecution().toString()
    assert [r.name for r in s.sheet("people").where(["domain=01"]).collect()] == ["a"]
    assert s.sheet("people").candidate_paths({"domain": "02"}).count() == 2


def test_indexes(spark, store):
    sheet = store.sheet("users")
    sheet.define_index("team", "team")
    sheet.define_index("email", lambda d: F.lower(d["email"]), unique=True, eager=True)
    assert [r["slug"] for r in sheet.find_by_index("team", "eng")] == ["bob", "jane"] and sheet.find_by_index("email", "mia@x.org")["slug"] == "mia" and sheet.find_by_index("email", "no") is None
    with pytest.raises(IndexError_):
        sheet.find_by_index("nothing", "x")
    head = store.head
    with pytest.raises(IndexError_) as e, store.transact() as tx:
        tx.upsert("users", spark.createDataFrame([("jane2", "JANE@x.org", None)], FIELDS))
    assert "jane" in str(e.value) and store.head == head
    with store.transact() as tx:
        tx.upsert("users", spark.createDataFrame([("mia", "other@x.org", None)], FIELDS))
    assert store.sheet("users").find_by_index("email", "mia@x.org") is None and store.sheet("users").find_by_index("email", "other@x.org")["slug"] == "mia"
    keys = spark.createDataFrame([("eng",), ("zzz",)], "key string")
    assert store.sheet("users").find_many_by_index("team", keys).count() == 3


def test_attachments(spark, store):
    with store.transact() as tx:
        tx.attach("users", "bob", {"a.png": b"\x00\xff", "b.txt": b"hi"})
        tx.attach("users", "bob", {"b.txt": b"ho"})
        tx.attach("users", "mia", {"c": b""})
        with pytest.raises(NotFoundError):
            tx.attach("users", "none", {"x": b""})
    sheet = store.sheet("users")
    assert sheet.attachment("bob", "a.png") == (b"\x00\xff", "image/png") and sheet.attachment("bob", "b.txt")[0] == b"ho" and sheet.attachments("bob").count() == 2
    with store.transact() as tx:
        tx.rename("users", "bob", "rob")
        tx.delete("users", "mia")
        assert tx.detach("users", "rob", "a.png") and not tx.detach("users", "jane")
        with pytest.raises(NotFoundError):
            tx.detach("users", "rob", "a.png")
    assert [(r._path, r.name) for r in store.sheet("users").attachments().collect()] == [("rob", "b.txt")]


def test_hooks_validators_and_trailers(spark, tmp_path, store):
    seen = []
    store.hooks += [lambda c: seen.append(c.message), lambda c: 1 / 0]
    store.validators["users"] = lambda d: d.withColumn("email", F.lower("email"))
    with store.transact("Hooked", author="A <a@x>") as tx:
        tx.upsert("users", spark.createDataFrame([("up", "UP@X.ORG", None)], FIELDS))
    assert seen == ["Hooked"] and tx.result.author == "A <a@x>" and store.sheet("users").query({"slug": "up"}).first().email == "up@x.org"
    with pytest.raises(ConfigError):
        Store(spark, store.root, validators={"unknown": lambda d: d})
    for bad in ({"a b": "x"}, {"A": "x\ny"}):
        with pytest.raises(ConfigError):
            check_trailers(bad)


MEAL = {"$id": "https://x.org/meal", "properties": {"name": {"minLength": 1, "type": "string"}}, "required": ["name"], "type": "object"}


def test_contracts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "c"))
    with s.transact() as tx:
        tx.write_config("meals", {"path": "${{ slug }}", "schema": {"properties": {"slug": {"minLength": 1}}}})
        tx.upsert("meals", spark.createDataFrame([("a", "Soup"), ("b", "")], "slug string, name string"))
    report = contracts.verify(s, s.sheet("meals"), "x.org/meal", MEAL)
    assert report.rung == "structural" and not report.conforms and report.records_read == 2
    with pytest.raises(ContractError) as e:
        contracts.adopt(s, "x.org/meal", MEAL, ["meals"])
    assert e.value.code == "contract_mismatch" and contracts.vendored(s) == []
    with s.transact() as tx:
        tx.patch("meals", {"slug": "b"}, {"name": "Bread"})
    contracts.adopt(s, "x.org/meal", MEAL, ["meals"])
    assert contracts.verify(s, s.sheet("meals"), "x.org/meal", MEAL).rung == "declared" and contracts.verify(s, s.sheet("meals"), "x.org/meal", MEAL).records_read == 0
    with pytest.raises(ValidationError) as e, s.transact() as tx:
        tx.upsert("meals", spark.createDataFrame([("c", "")], "slug string, name string"))
    issue = e.value.issues[0]
    assert issue["code"] == "minLength" and contracts.source_of("#/allOf/0/x", s.sheet("meals").config) == "x.org/meal" and contracts.source_of("#/allOf/1/x", s.sheet("meals").config) == "schema"
    assert contracts.sync(s, "x.org/meal", MEAL) == "match" and contracts.sync(s, "x.org/meal", {**MEAL, "title": "t"}) == "drift"
    assert '"$id": "https://x.org/meal"' in contracts.export(s, "x.org/meal") and contracts.test(s.sheet("meals"), MEAL).conforms and contracts.prune(s) == []
    contracts.adopt(s, "x.org/unused", {"$id": "https://x.org/unused"}, [])
    assert contracts.prune(s) == ["x.org/unused"] and contracts.vendored(s) == ["x.org/meal"]
    assert s.sheet_names() == ["meals"]


@pytest.mark.parametrize("extra", [{"$id": "https://y"}, {"additionalProperties": False}, {"properties": {"a": {"$ref": "other.json"}}}, {"properties": {"note": {"type": ["null", "string"]}}}, {"properties": {"a": {"const": None}}}, {"strange": 1}])
def test_bad_contracts(extra):
    with pytest.raises(ContractError):
        contracts.check_document("x.org/meal", {**MEAL, **extra})


def test_contract_names_and_hashes():
    for bad in ("meal", "x.org", "x.org//a", "x.org/../a", "host/a", "x.org/a b"):
        with pytest.raises(ContractError):
            contracts.check_name(bad)
    assert contracts.canonical_hash({"b": 1, "a": 2}) == contracts.canonical_hash('{"a": 2, "b": 1}') == contracts.canonical_hash("a = 2\nb = 1\n")
    with pytest.raises(ContractError):
        contracts.load({"contracts/x.org/a": '"$id"="https://x.org/a"'}, "x.org/a")
    with pytest.raises(ContractError):
        contracts.load({}, "x.org/a")


def test_writes_touch_only_their_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("recordloom.store.MAX_BASES", 5)
    s = Store(spark, str(tmp_path / "p"))
    rows = [(f"d{k % 20}", f"n{k}", k) for k in range(200)]
    with s.transact() as tx:
        tx.write_config("people", {"path": "${{ domain }}/${{ name }}"})
        tx.upsert("people", spark.createDataFrame(rows, "domain string, name string, n int"))
    first = s.head
    want = {(d, n): k for d, n, k in rows}

    def now():
        return {(r.domain, r.name): r.n for r in s.sheet("people").query().collect()}

    def bases():
        return Snapshot.of(s.sheet("people").snapshot).bases

    with s.transact() as tx:
        tx.upsert("people", spark.createDataFrame([("d3", "n3", -1), ("d3", "new", 7), ("d4", "n4", 4)], "domain string, name string, n int"))
    want |= {("d3", "n3"): -1, ("d3", "new"): 7}
    assert now() == want and len(bases()) == 2 and bases()[0][1] == ("d3",)
    assert "PartitionFilters: [NOT" in s.sheet("people").records()._jdf.queryExecution().toString()
    with s.transact() as tx:
        tx.delete("people", "d5/n5")
        assert tx.delete_where("people", ["n>=190", "domain!=d19"]) == 9
        tx.patch("people", {"domain": "d6", "name": "n6"}, {"domain": "d7"})
    del want["d5", "n5"], want["d6", "n6"]
    want = {k: v for k, v in want.items() if v < 190 or k[0] == "d19"} | {("d7", "n6"): 6}
    assert now() == want
    assert {(r.path, r.status) for r in s.diff("people", first).collect()} >= {("d5/n5", "deleted"), ("d6/n6", "deleted"), ("d7/n6", "added"), ("d3/n3", "modified")}
    for k in range(2):
        with s.transact() as tx:
            tx.upsert("people", spark.createDataFrame([("d1", "n1", 1000 + k)], "domain string, name string, n int"))
        want["d1", "n1"] = 1000 + k
        assert now() == want
    assert len(bases()) <= 5
    whole = Snapshot.of(s.sheet("people").snapshot)
    with s.transact() as tx:
        tx.upsert("people", s.sheet("people").query().drop("_path", "_blob"), delete_missing=True)
    assert tx.result is None
    with s.transact() as tx:
        tx.stage("people", tx.records("people"))
    assert tx.result is None and whole.rows == len(want)


def test_prefixes_and_locks_left_behind(spark, tmp_path):
    from recordloom import store as module

    a = Store(spark, f"{tmp_path}/p", prefix="a")
    with a.transact("Declare") as tx:
        tx.write_config("people", {"path": "${{ id }}"})
        tx.upsert("people", spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z")], "id string, name string"))
    assert {(r.id, r.name) for r in a.sheet("people").records().collect()} == {("1", "y"), ("2", "z")}
    b = Store(spark, f"{tmp_path}/p", prefix="b")
    assert b.sheet_names() == ["people"] and b.sheet("people").records().count() == 0
    b.files.create(json.dumps({"owner": "gone", "time": 0}), "lock")
    b.sheet("people").upsert(spark.createDataFrame([("9", "q")], "id string, name string"))
    assert a.sheet("people").records().count() == 2 and not b.files.exists("lock")
    b.files.create(json.dumps({"owner": "here", "time": 4e9}), "lock")
    with pytest.raises(module.TransactionError) as e:
        b.sheet("people").clear()
    assert e.value.code == "lock_held"
    b.files.delete("lock")
    b.sheet("people").clear()
    assert b.sheet("people").records().count() == 0
