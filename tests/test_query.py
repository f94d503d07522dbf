import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import Row

from sedge import Converter, MemoryTables, ModelConfig, NotFoundError, TranslationError, Workspace, WorkspacePool
from sedge.functions import expr as X
from sedge.plans.spec import Spec
from sedge.workspace import ManyLoadsWarning


def blog_model():
    m = ModelConfig()
    for name in ("User", "Blog", "Post", "Comment", "Tag"):
        m.entity(name).table(name.lower() + "s").key("id")
    u, b, p = m.configure("User"), m.configure("Blog"), m.configure("Post")
    u.property("name")
    u.property("age")
    u.property("active").of_type("boolean")
    u.owns_one("address", "Address")
    m.entity("Address").property("city")
    b.has_many("posts", "Post").with_one("blog").foreign_key("blogId")
    p.has_one("author", "User").with_many("posts").foreign_key("authorId")
    p.has_many("comments", "Comment").with_one("post").foreign_key("postId")
    p.property("title").column("heading")
    p.has_many("tags", "Tag").with_many("posts", "PostTag")
    m.entity("PostTag").table("posttags").key("postId", "tagId").property("postId")
    return m


@pytest.fixture(scope="module")
def tables(spark):
    t = MemoryTables(spark)
    t.seed("users", [(1, "Amal", 30, True, "Cairo"), (2, "Bilal", 17, True, None), (3, "Aisha", 25, True, "Fes"), (4, "Ziad", 41, False, "Tunis"), (5, None, None, True, None)], "id long, name string, age int, active boolean, address_city string")
    t.seed("blogs", [(1, "b1"), (2, "b2")], "id long, title string")
    t.seed("posts", [(1, "first", 1, 1), (2, "second", 1, 3), (3, None, None, 1)], "id long, heading string, blogId long, authorId long")
    t.seed("comments", [(1, "x", 1), (2, "y", 1), (3, "z", 2)], "id long, text string, postId long")
    t.seed("tags", [(1, "t1"), (2, "t2")], "id long, label string")
    t.seed("posttags", [(1, 1), (1, 2), (2, 2)], "postId long, tagId long")
    return t


@pytest.fixture()
def w(spark, tables):
    return Workspace(spark, tables, blog_model())


def names(q):
    return [x.name for x in q.to_list()]


def test_order_page_and_terminals(w):
    users = w.set("User")
    adults = users.where(lambda u: u.age >= 18).order_by("name")
    assert names(adults.take(2)) == ["Aisha", "Amal"]
    page = users.order_by("id").to_page(2, 3)
    assert (page.total, [u.id for u in page.items]) == (5, [4, 5])
    assert users.count() == 5 and users.where(lambda u: u.age > 100).any() is False
    assert users.sum("age") == 113 and users.max(lambda u: u.name) == "Ziad" and users.where(lambda u: u.age > 99).sum("age") == 0
    assert users.order_by("name").first().name is None and users.order_by_desc("name").first().name == "Ziad"
    assert users.where(lambda u: u.id == 9).first_or_none() is None
    with pytest.raises(NotFoundError):
        users.where(lambda u: u.id == 9).single()
    with pytest.raises(NotFoundError):
        users.single_or_none()
    assert users.skip(3).take(1).count() == 5
    assert users.select(lambda u: {"active": u.active}).distinct().count() == 2


def test_nulls_follow_sql(w):
    users = w.set("User")
    assert users.where(lambda u: u.name != "Amal").count() == 3
    assert users.where(lambda u: ~(u.name == "Amal")).count() == 3
    assert [u.id for u in users.where(lambda u: u.name.is_null()).to_list()] == [5]


def test_distinct_projection_orders_last(w):
    q = w.set("Comment").select(lambda c: {"postId": c.postId}).distinct()
    assert [r["postId"] for r in q.order_by_desc("postId").to_list()] == [2, 1]
    with pytest.raises(TranslationError):
        q.order_by("text").to_list()


def test_like_family_is_literal(spark):
    t = MemoryTables(spark).seed("items", [(1, "a%b"), (2, "axb"), (3, "A%B")], "id long, name string")
    w = Workspace(spark, t)
    ids = lambda f: sorted(x.id for x in w.set("Item").as_no_tracking().where(f).to_list())
    w.model  # an undeclared entity: table "Items"
    t.seed("Items", t.frames["items"])
    assert ids(lambda x: x.name.contains("%")) == [1, 3] and ids(lambda x: x.name.like("a%b")) == [1, 2] and ids(lambda x: x.name.starts_with("a%")) == [1]


def test_owned_values(w):
    assert names(w.set("User").where(lambda u: u.address.city == "Fes")) == ["Aisha"]
    got = w.set("User").order_by("id").to_list()
    assert got[0].address.city == "Cairo" and got[1].address is None


def test_navigations(w):
    ids = lambda e, f: sorted(x.id for x in w.set(e).where(f).to_list())
    assert ids("Blog", lambda b: b.posts.any()) == [1]
    assert ids("Blog", lambda b: ~b.posts.any()) == [2]
    assert ids("User", lambda u: u.posts.all(lambda p: p.title == "second")) == [2, 3, 4, 5]  # a null title does not count as failing; "first" does
    assert ids("User", lambda u: u.posts.count() >= 2) == [1]
    assert ids("User", lambda u: u.posts.any(lambda p: p.comments.any(lambda c: c.text == "z"))) == [3]
    assert ids("Post", lambda p: p.author.name == "Amal") == [1, 3]
    assert ids("Post", lambda p: p.tags.any(lambda t: t.label == "t1")) == [1]
    assert ids("Comment", lambda c: c.post.author.address.city == "Fes") == [3]
    rows = w.set("User").select(lambda u: {"id": u.id, "n": u.posts.count(), "loud": u.name.upper()}).order_by("id").to_list()
    assert [(r["n"], r["loud"]) for r in rows] == [(2, "AMAL"), (0, "BILAL"), (1, "AISHA"), (0, "ZIAD"), (0, None)]
    with pytest.raises(TranslationError):
        w.set("User").where(lambda u: u.posts.title == "x").to_df()
    with pytest.raises(TranslationError):
        w.set("Post").where(lambda p: p.author.any()).to_df()


def test_plans_are_semi_joins(w):
    assert "LeftSemi" in w.set("Blog").where(lambda b: b.posts.any()).explain()
    assert "LeftAnti" in w.set("Blog").where(lambda b: ~b.posts.any()).explain()


def test_includes(w):
    blogs = w.set("Blog").include("posts").then_include("comments").include("posts.author").order_by("id").to_list()
    assert [[p.title for p in b.posts] for b in blogs] == [["first", "second"], []]
    assert [c.text for c in blogs[0].posts[0].comments] == ["x", "y"] and blogs[0].posts[1].author.name == "Aisha"
    posts = w.set("Post").include("blog").include("tags").as_no_tracking().order_by("id").to_list()
    assert [p.blog and p.blog.title for p in posts] == ["b1", "b1", None] and [[t.id for t in p.tags] for p in posts] == [[1, 2], [2], []]
    some = w.set("Blog").include("posts", where=lambda p: p.title == "first").order_by("id").as_no_tracking().to_list()
    assert [len(b.posts) for b in some] == [1, 0]
    with pytest.raises(TranslationError):
        w.set("Blog").then_include("posts")


def test_explicit_and_lazy_loading(w):
    post = w.set("Post").where(lambda p: p.id == 1).single()
    ref = w.entry(post, "Post").reference("author")
    assert not ref.loaded and ref.load().name == "Amal" and post.author.name == "Amal"
    assert [c.id for c in w.entry(post, "Post").collection("comments").query().order_by("id").to_list()] == [1, 2]
    assert sorted(t.label for t in w.entry(post, "Post").collection("tags").load()) == ["t1", "t2"]
    with pytest.warns(ManyLoadsWarning):
        for _ in range(10):
            w.entry(post, "Post").collection("comments").load()


def test_identity_map(w):
    a = w.set("User").where(lambda u: u.id == 1).first()
    a.name = "changed"
    assert w.set("User").find(1) is a and w.set("User").order_by("id").first() is a
    assert w.set("User").as_no_tracking().order_by("id").first() is not a
    assert w.entry(a, "User").modified_properties() == ["name"]


def test_filters_and_type_gates(spark, tables):
    m = blog_model()
    m.configure("User").query_filter(lambda u: u.active == True)  # noqa: E712
    w = Workspace(spark, tables, m)
    assert w.set("User").count() == 4 and w.set("User").ignore_query_filters().count() == 5
    assert sorted(p.id for p in w.set("Post").include("author").to_list()) == [1, 2, 3]
    for bad in (lambda u: u.age.lower() == "x", lambda u: u.active > True, lambda u: u.age.starts_with("1")):
        with pytest.raises(TranslationError):
            w.set("User").where(bad).to_df()


def test_discriminator_and_raw_sql(spark):
    m = ModelConfig()
    for name in ("Dog", "Cat"):
        m.entity(name).table("animals").key("id").discriminator("kind", name.lower())
    t = MemoryTables(spark).seed("animals", [(1, "dog", "a"), (2, "cat", "b"), (3, "dog", "c")], "id long, kind string, name string")
    w = Workspace(spark, t, m)
    assert w.set("Dog").count() == 2
    raw = w.set("Cat").from_sql("SELECT * FROM {t} WHERE name <> :n", {"t": t.frames["animals"]}, n="a' OR '1'='1")
    assert raw.count() == 3 and [x.id for x in raw.where(lambda x: x.id > 1).order_by_desc("id").to_list()] == [3, 2]


def test_converters(spark):
    m = ModelConfig()
    e = m.entity("Account").table("accounts").key("id")
    e.property("tags").convert("json")
    e.property("at").convert("iso")
    e.property("premium").convert("bool01")
    t = MemoryTables(spark).seed("accounts", [(1, '["a","b"]', "2024-01-02T03:04:05.000Z", 1), (2, None, None, 0)], "id long, tags string, at string, premium int")
    w = Workspace(spark, t, m)
    a = w.set("Account").where(lambda x: x.premium == True).single()  # noqa: E712
    assert a.tags == ["a", "b"] and a.at == dt.datetime(2024, 1, 2, 3, 4, 5) and a.premium is True
    assert w.set("Account").where(lambda x: x.at == dt.datetime(2024, 1, 2, 3, 4, 5)).count() == 1
    assert w.set("Account").select(lambda x: {"tags": x.tags}).take(1).to_list()[0]["tags"] == ["a", "b"]
    first = w.set("Account").order_by("id").to_df(converted=True).first()
    assert first["premium"] is True and first["at"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    m2 = ModelConfig()
    m2.entity("Account").key("id").property("tags").convert("none such")
    with pytest.raises(Exception, match="none such"):
        Workspace(spark, t, m2)
    Workspace(spark, t, m2, converters=[Converter("none such", str, str)])


def test_pool(spark, tables):
    pool = WorkspacePool(lambda: Workspace(spark, tables, blog_model()))
    with pool.scope() as w:
        w.set("User").first()
        assert w.tracker.entries
    with pool.scope() as again:
        assert again is w and not again.tracker.entries


def test_random_predicates_equal_duckdb(spark):
    """Three hundred random conditions over forty rows, as boolean columns of one plan."""
    rows = [(i + 1, (7 * i) % 60, (13 * i) % 100 if i % 7 else None, i % 3 == 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, age int, score int, active boolean")
    r = random.Random(1)
    sql = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}

    def tree(depth):
        kind = r.choice(["cmp", "cmp", "in", "bool", "null"] + ["not", "and", "or"] * (depth > 0))
        col = r.choice(["age", "score"])
        if kind == "cmp":
            op, v = r.choice(list(sql)), r.randint(0, 100)
            return X.Compare(op, X.Field((col,)), X.Literal(v)), f"({col} {sql[op]} {v})"
        if kind == "in":
            vs = tuple(r.randint(0, 99) for _ in range(r.randint(1, 5)))
            return X.Member(X.Field((col,)), vs), f"({col} IN ({', '.join(map(str, vs))}))"
        if kind == "bool":
            return X.Compare("eq", X.Field(("active",)), X.Literal(True)), "active"
        if kind == "null":
            return X.NullTest(X.Field((col,))), f"({col} IS NULL)"
        if kind == "not":
            a, s = tree(depth - 1)
            return X.Negation(a), f"(NOT {s})"
        (a, s), (b, t) = tree(depth - 1), tree(depth - 1)
        return X.Junction(kind, (a, b)), f"({s} {kind.upper()} {t})"

    trees = [tree(3) for _ in range(300)]
    w = Workspace(spark, MemoryTables(spark).seed("Rows", frame))
    b = w.binder()
    scope = b.scope(b.model.entity("Row"))
    got = [tuple(x) for x in scope.frame.select("id", *(b.condition(scope, n).alias(f"c{i}") for i, (n, _) in enumerate(trees))).orderBy("id").collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (id INT, age INT, score INT, active BOOLEAN)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    assert got == c.execute(f"SELECT id, {', '.join(s for _, s in trees)} FROM t ORDER BY id").fetchall()
    assert w.binder().bind(Spec("Row", where=(trees[0][0],))).count() == sum(x[1] is True for x in got)
    assert isinstance(frame.first(), Row)


def test_whole_tables_change_by_conditions_alone(w, spark, tables):
    """Steps that a whole-table change cannot mind are refused, before any row is lost."""
    users = w.set("User")
    raw = users.from_sql("SELECT * FROM {t} WHERE id = 1", {"t": tables.frames["users"]})
    for q in (raw, raw.where(lambda u: u.age > 1), users.take(1), users.skip(1), users.select(lambda u: {"n": u.name}), users.select(lambda u: {"n": u.name}).distinct()):
        for change in (q.remaining_df, lambda q=q: q.updated_df({"age": 1}), q.delete, lambda q=q: q.update({"age": 1})):
            with pytest.raises(TranslationError):
                change()
    assert users.where(lambda u: u.age > 20).remaining_df().count() == 2
