import pytest

from sedge.errors import ModelError
from sedge.model import conventions as C
from sedge.model.build import TITLES, ModelConfig
from sedge.model.snapshot import Snapshot


@pytest.mark.parametrize(
    "one, many",
    [("", ""), ("sheep", "sheep"), ("Person", "People"), ("child", "children"), ("baby", "babies"), ("day", "days"), ("y", "ys"), ("bus", "buses"), ("box", "boxes"), ("quiz", "quizes"), ("church", "churches"), ("dish", "dishes"), ("knife", "knives"), ("wolf", "wolves"), ("User", "Users")],
)
def test_plurals(one, many):
    assert C.plural(one) == many


def blog() -> ModelConfig:
    m = ModelConfig()
    u = m.entity("User").key("id")
    u.property("email").column("email_address").max_length(200)
    u.owns_one("address", "Address")
    u.has_many("posts", "Post").with_one("author").foreign_key("authorId")
    u.has_many("roles", "Role").with_many("users", "UserRole")
    m.entity("Address").property("city").column("addr_city")
    p = m.entity("Post").key("id")
    p.property("title").required()
    p.property("tags").convert("json")
    p.query_filter(lambda x: x.title.is_not_null())
    p.index("title").unique()
    m.entity("Role").key("id")
    m.entity("UserRole").key("userId", "roleId")
    return m


def test_rich_model():
    s = blog().finish()
    u, a, p = s.entity("User"), s.entity("Address"), s.entity("Post")
    assert (u.table, a.table, a.owned) == ("Users", "Users", True)
    assert a.by_name["city"].column == "address_addr_city"
    assert u.by_name["id"].generated == "on_add" and u.by_name["email"].type == "string"
    assert p.navs["author"].foreign_key == ("authorId",) and not p.navs["author"].many
    assert u.navs["roles"].through == "UserRole" and s.entity("Role").navs["users"].many
    assert p.indexes[0].name == "IX_Posts_title" and p.indexes[0].unique
    assert s.entity("UserRole").by_name["userId"].generated == "never"
    assert s.entity("Unknown").table == "Unknowns" and s.entity("Unknown").key == ("id",)


def test_snapshot_is_stable():
    text = blog().finish().to_json()
    assert text == blog().finish().to_json() == Snapshot.from_json(text).to_json() and text.endswith("}\n")


def test_shadow_foreign_keys_and_behaviours():
    m = ModelConfig()
    m.entity("Owner").key("id").owns_many("tags", "Tag")
    m.entity("Tag").property("name")
    m.entity("Employee").key("id").has_one("manager", "Employee").required(False)
    s = m.finish()
    assert s.entity("Tag").by_name["ownerId"] and s.entity("Owner").navs["tags"].foreign_key == ("ownerId",)
    e = s.entity("Employee")
    assert e.navs["manager"].foreign_key == ("managerId",) and e.by_name["managerId"].nullable and e.navs["manager"].on_delete == "set_null"


def _bad(code, build):
    return pytest.param(code, build, id=f"{code}-{build.__code__.co_firstlineno}")


def _two(m, first=None, second=None):
    a, b = m.entity("A").key("id").table("t"), m.entity("B").key("id").table("t")
    if first:
        a.discriminator("kind", first)
    if second:
        b.discriminator("kind", second)


BAD = [
    _bad("SE1201", lambda m: m.entity("A").property("name")),
    _bad("SE1202", lambda m: m.entity("A").key("b").has_one("b", "A")),
    _bad("SE1203", lambda m: (m.entity("A").key("id"), m.entity("A"))),
    _bad("SE1204", lambda m: _two(m)),
    _bad("SE1204", lambda m: _two(m, "a")),
    _bad("SE1205", lambda m: (m.entity("A").key("id").property("x").column("c"), m.configure("A").property("y").column("c"))),
    _bad("SE1206", lambda m: m.entity("A").key("id").property("x").max_length(0)),
    _bad("SE1206", lambda m: m.entity("A").key("id").property("x").max_length(1.5)),
    _bad("SE1207", lambda m: (m.entity("A").key("id").has_one("b", "B").foreign_key("x", "y"), m.entity("B").key("id"))),
    _bad("SE1208", lambda m: (m.entity("A").key("id").has_one("b", "B"), m.entity("B").key())),
    _bad("SE1208", lambda m: (m.entity("A").key().has_many("b", "B"), m.entity("B").key("id"))),
    _bad("SE1209", lambda m: _two(m, "a", "a")),
    _bad("SE1210", lambda m: m.entity("A").key("x", "x")),
    _bad("SE1211", lambda m: (m.entity("A").key("id").property("x"), m.configure("A").data({"x": 1}))),
    _bad("SE1212", lambda m: m.entity("A").key("id").data({"id": 1, "z": 1})),
    _bad("SE1212", lambda m: m.entity("A").key("id").data(3)),
    _bad("SE1213", lambda m: m.entity("A").key("id").index("z")),
    _bad("SE1214", lambda m: m.entity("A").key("id").index()),
    _bad("SE1215", lambda m: m.entity("A").key("id").property("x").convert("")),
    _bad("SE1216", lambda m: (m.entity("A").key("id").owns_one("b", "B"), m.entity("B").key("id"))),
    _bad("SE1217", lambda m: m.entity("A").key("id").property("x").column("")),
    _bad("SE1218", lambda m: m.entity("A").key("id").property("id").concurrency_token()),
    _bad("SE1219", lambda m: m.entity("A").key("id").table("")),
    _bad("SE1220", lambda m: (m.entity("A").key("id").has_many("bs", "B").with_many("as_", "AB"), m.entity("B").key("id"))),
    _bad("SE1221", lambda m: (m.entity("A").key("id").property("b"), m.configure("A").has_one("b", "A"))),
    _bad("SE1222", lambda m: m.entity("A").key("id").discriminator("kind")),
    _bad("SE1223", lambda m: m.entity("A").key("id").property("x").default(1).default_sql("1")),
]


@pytest.mark.parametrize("code, build", BAD)
def test_faults(code, build):
    m = ModelConfig()
    build(m)
    with pytest.raises(ModelError) as e:
        m.finish()
    assert code in {d.code for d in e.value.diagnostics}


def test_every_code_is_covered():
    assert {p.values[0] for p in BAD} == set(TITLES)


def test_markers():
    from sedge import markers

    markers.clear_markers()

    @markers.entity("people")
    @markers.key("id")
    @markers.column("name", max_length=50, column="full_name")
    @markers.has_many("pets", "Pet", inverse="owner", foreign_key="ownerId")
    class Person:
        pass

    m = ModelConfig()
    m.entity("Pet").key("id")
    m.configure("Person").property("name").column("said")
    s = markers.apply_markers(m).finish()
    assert s.entity("Person").table == "people" and s.entity("Person").by_name["name"].column == "said" and s.entity("Person").by_name["name"].max_length == 50
    assert s.entity("Pet").navs["owner"].foreign_key == ("ownerId",)
    markers.clear_markers()
