import datetime as dt

import pytest

from sedge import ConcurrencyError, ModelConfig, Record, SedgeError, VersionedTables, Workspace
from sedge.plugins import SoftDelete, Tenancy, Timestamps
from sedge.tracking import State


class User:
    def __init__(self, name=None, age=None, **more):
        self.id = None
        self.name, self.age, self.version = name, age, 1
        self.__dict__.update(more)


class Post:
    def __init__(self, title, author=None):
        self.id, self.title, self.author, self.authorId = None, title, author, None


def shop(behaviour="cascade"):
    m = ModelConfig()
    u = m.entity("User").key("id")
    u.property("name").of_type("string")
    u.property("age").of_type("number").required(False)
    u.property("version").of_type("number").concurrency_token()
    u.has_many("posts", "Post").with_one("author").foreign_key("authorId").on_delete(behaviour)
    m.entity("Post").key("id").property("title").of_type("string")
    c = m.configure("Post")
    c.has_many("comments", "Comment").with_one("post").foreign_key("postId")
    m.entity("Comment").key("id").property("text").of_type("string")
    return m


@pytest.fixture()
def make(spark, tmp_path):
    def build(model=None, **more):
        model = model or shop()
        probe = Workspace(spark, None, model, **{k: v for k, v in more.items() if k == "plugins"})
        tables = VersionedTables(spark, str(tmp_path / "store"), probe.model)
        return lambda: Workspace(spark, tables, probe.model, **more)

    return build


def test_insert_update_delete(make):
    new = make()
    w = new()
    amal = User("Amal", 30)
    w.set(User).add(amal)
    w.set(Post).add(Post("first", amal))
    assert w.save_changes() == 2 and amal.id == 1 and w.entry(amal).state == State.UNCHANGED
    assert w.save_changes() == 0
    w = new()
    got = w.set(User).find(1)
    assert (got.name, got.age) == ("Amal", 30) and w.set(Post).first().authorId == 1
    got.age, got.version = 31, 2
    assert w.entry(got).modified_properties() == ["age", "version"]
    assert w.save_changes() == 1
    w = new()
    assert w.set(User).single().age == 31
    w.set(User).remove(w.set(User).single())
    assert w.save_changes() == 1 and new().set(User).count() == 0 and new().set(Post).count() == 0
    assert w.tables.vacuum() > 0


def test_stale_update_fails_and_nothing_is_written(make):
    new = make()
    w = new()
    w.set(User).add(User("A", 1))
    w.save_changes()
    a, b = new(), new()
    x, y = a.set(User).single(), b.set(User).single()
    x.age, x.version = 2, 2
    a.save_changes()
    y.age = 3
    b.set(User).add(User("B", 9))
    with pytest.raises(ConcurrencyError) as e:
        b.save_changes()
    assert e.value.entries[0].item is y
    assert new().set(User).single().age == 2
    assert b.entry(y).state == State.MODIFIED


def test_duplicate_key_aborts_all(make):
    new = make()
    w = new()
    w.set(User).add(User("A", 1))
    w.save_changes()
    w = new()
    u = User("B", 2)
    u.id = 1
    w.set(User).add(u)
    w.set(User).add(User("C", 3))
    with pytest.raises(SedgeError):
        w.save_changes()
    assert new().set(User).count() == 1


@pytest.mark.parametrize("behaviour, posts, comments", [("cascade", 0, 0), ("set_null", 1, 1), ("no_action", 1, 1), ("restrict", None, None)])
def test_delete_behaviours(make, behaviour, posts, comments):
    new = make(shop(behaviour))
    w = new()
    u = w.set(User).add(User("A", 1))
    p = w.set(Post).add(Post("t", u))
    w.set("Comment").add(Record(id=None, text="c", post=p))
    w.save_changes()
    w = new()
    w.set(User).remove(w.set(User).single())
    if posts is None:
        with pytest.raises(SedgeError):
            w.save_changes()
        assert new().set(User).count() == 1
        return
    w.save_changes()
    assert (new().set(Post).count(), new().set("Comment").count()) == (posts, comments)
    if behaviour == "set_null":
        assert new().set(Post).single().authorId is None


def test_transaction_restores_tables_and_tracker(make):
    new = make()
    w = new()
    u = w.set(User).add(User("A", 1))
    with pytest.raises(RuntimeError), w.transaction():
        w.save_changes()
        with w.transaction():
            raise RuntimeError
    assert new().set(User).count() == 0 and w.entry(u).state == State.ADDED
    with w.transaction():
        w.save_changes()
    assert new().set(User).count() == 1


def test_bulk_update_and_delete(make):
    new = make()
    w = new()
    for n in range(5):
        w.set(User).add(User(f"u{n}", n))
    w.save_changes()
    assert w.set(User).where(lambda u: u.age >= 3).update({"name": "old"}) == 2
    assert w.set(User).where(lambda u: u.age < 2).delete() == 2
    assert sorted(u.name for u in new().set(User).to_list()) == ["old", "old", "u2"]


def test_owned_and_converted_values_round_trip(make):
    m = ModelConfig()
    u = m.entity("User").key("id")
    u.property("tags").convert("json").of_type("string")
    u.owns_one("address", "Address")
    m.entity("Address").property("city").of_type("string").required(False)
    new = make(m)
    w = new()
    u = w.set("User").add(Record(id=None, tags=["a"], address=Record(city="Fes")))
    w.save_changes()
    assert u.tags == ["a"]
    got = new().set("User").single()
    assert got.tags == ["a"] and got.address.city == "Fes"


def test_plugins(make):
    now, tenant = [dt.datetime(2024, 1, 1)], ["acme"]
    m = ModelConfig()
    m.entity("Note").key("id").property("text").of_type("string")
    new = make(m, plugins=[SoftDelete(), Timestamps(clock=lambda: now[0]), Tenancy(lambda: tenant[0])])
    w = new()
    for t in "ab":
        w.set("Note").add(Record(id=None, text=t))
    w.save_changes()
    now[0] = dt.datetime(2024, 2, 1)
    w.set("Note").remove(w.set("Note").where(lambda n: n.text == "a").single())
    w.save_changes()
    left = new().set("Note").single()
    assert (left.text, left.tenantId, left.createdAt, left.updatedAt) == ("b", "acme", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))
    raw = w.tables.read(w.model.entity("Note")).orderBy("id").collect()
    assert raw[0]["isDeleted"] is True and raw[0]["updatedAt"] == dt.datetime(2024, 2, 1)
    tenant[0] = "globex"
    assert w.set("Note").count() == 0
    assert w.set("Note").select(lambda n: {"t": n.text}).to_list() == []  # the tenant's condition survives a projection
    left.text = "stolen"
    thief = new()
    thief.set("Note").attach(left)
    left.text = "again"
    with pytest.raises(SedgeError):
        thief.save_changes()


def test_interceptors_and_read_only(make, spark):
    from sedge import MemoryTables

    seen = []

    class Log:
        def saving(self, w, entries):
            seen.append(("saving", len(entries)))

        def saved(self, w, entries):
            seen.append(("saved", len(entries)))

    w = make(interceptors=[Log()])()
    w.set(User).add(User("A", 1))
    w.save_changes()
    assert seen == [("saving", 1), ("saved", 1)]
    ro = Workspace(spark, MemoryTables(spark), shop())
    ro.set(User).add(User("x", 1))
    with pytest.raises(SedgeError):
        ro.save_changes()
