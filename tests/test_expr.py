import pytest

from sedge.errors import TranslationError
from sedge.functions import expr as X


def test_records_small_nodes():
    node = X.record(lambda u: (u.age >= 18) & (u.name.lower() == "amal"))
    assert node == X.Junction("and", (X.Compare("ge", X.Field(("age",)), X.Literal(18)), X.Compare("eq", X.Cased("lower", X.Field(("name",))), X.Literal("amal"))))
    assert X.from_json(X.to_json(node)) == node


def test_named_methods_and_shadowed_members():
    assert X.record(lambda u: u["count"].eq(3)) == X.Compare("eq", X.Field(("count",)), X.Literal(3))
    assert X.record(lambda u: u.a.between(1, 2)) == X.record(lambda u: (u.a >= 1) & (u.a <= 2))
    assert X.record(lambda u: u.a.is_in([])) == X.Truth(False)
    assert X.record(lambda u: u.posts.any(lambda p: p.title.is_null())).predicate == X.NullTest(X.Field(("title",)))
    assert X.record(lambda u: u.posts.count() >= 2).left == X.ChildCount(X.Field(("posts",)))


@pytest.mark.parametrize(
    "bad",
    [
        lambda u: u.a == None,  # noqa: E711
        lambda u: u.a == 1 and u.b == 2,
        lambda u: not (u.a == 1),
        lambda u: u.a,
        lambda u: u.a == object(),
        lambda u: u.a.starts_with(3),
        lambda u: u.posts.any(lambda p: p.author == u.name),
        lambda u: bool(u.a),
    ],
)
def test_untranslatable(bad):
    with pytest.raises(TranslationError):
        X.record(bad)


def test_paths():
    assert X.record_path(lambda u: u.address.city) == ("address", "city") == X.record_path("address.city")
    with pytest.raises(TranslationError):
        X.record_path(lambda u: u.a.lower())
