import datetime as dt

import pytest

from sedge import ModelConfig, Record, SedgeError, VersionedTables, Workspace
from sedge.cli import main
from sedge.migrations import Project, diff, migration_id
from sedge.model.snapshot import Snapshot


def model(step: int) -> Snapshot:
    m = ModelConfig()
    u = m.entity("User").table("users").key("id")
    u.property("name").max_length(100)
    u.data({"id": 1, "name": "root"})
    if step > 1:
        u.property("age").of_type("number").required(False)
        u.index("name").unique().named("ix_name")
        m.entity("Log").table("logs").key("id")
    return m.finish()


def project(spark, tmp_path, step, at):
    p = Project(model(step), tmp_path / "migrations", clock=lambda: at)
    p.tables = VersionedTables(spark, str(tmp_path / "store"), p.model)
    return p


def test_diff_kinds():
    assert [o.kind for o in diff(Snapshot(), model(1))] == ["create_table", "insert_rows"]
    up = diff(model(1), model(2))
    assert [o.kind for o in up] == ["create_table", "add_column", "create_index"] and not any(o.destructive for o in up)
    down = diff(model(2), model(1))
    assert [o.kind for o in down] == ["drop_index", "drop_column", "drop_table"] and down[-1].destructive
    assert diff(model(2), model(2)) == []


def test_id():
    assert migration_id("Add userBio!", dt.datetime(2026, 7, 22, 18, 37, 46)) == "20260722183746_add_user_bio"


def test_up_down_up(spark, tmp_path):
    p = project(spark, tmp_path, 1, dt.datetime(2026, 1, 1))
    first = p.add("init")
    assert p.add("again") is None and not p.has_pending_changes()
    p = project(spark, tmp_path, 2, dt.datetime(2026, 1, 2))
    assert p.has_pending_changes()
    second = p.add("more")
    run = p.runner()
    assert run.up() == [first.id, second.id] and run.up() == [] and [x[1] for x in p.list()] == [True, True]
    w = Workspace(spark, p.tables, p.model)
    root = w.set("User").single()
    assert root.name == "root" and root.age is None
    w.set("User").add(Record(id=None, name="b", age=3))
    w.save_changes()
    assert run.down() == [second.id] and "age" not in p.tables.read(p.model.entity("User")).columns
    assert run.up() == [second.id] and p.tables.read(p.model.entity("User")).count() == 2
    with pytest.raises(SedgeError):
        p.remove()
    run.down()
    assert p.remove() == second.id and p.has_pending_changes()
    assert "CREATE TABLE `users`" in p.script()


def test_repair(spark, tmp_path):
    p = project(spark, tmp_path, 1, dt.datetime(2026, 1, 1))
    p.add("init")
    assert not p.repair()
    text = p.snapshot_path.read_text()
    p.snapshot_path.write_text(f"<<<<<<< ours\n{text}=======\nother\n>>>>>>> theirs\n")
    assert not p.repair() and p.snapshot_path.read_text() == text
    p.snapshot_path.write_text("{}")
    assert p.repair()


def test_command_line(spark, tmp_path, capsys):
    config = tmp_path / "config.py"
    config.write_text(f"""
from pathlib import Path
from pyspark.sql import SparkSession
from sedge import ModelConfig, VersionedTables
from sedge.migrations import Project


def project():
    m = ModelConfig()
    m.entity("User").key("id").property("name").max_length(9)
    p = Project(m.finish(), Path({str(tmp_path)!r}) / "migrations")
    p.tables = VersionedTables(SparkSession.getActiveSession(), {str(tmp_path / "store")!r}, p.model)
    return p
""")
    run = lambda *a: (main(["--config", str(config), *a]), capsys.readouterr().out)[1]
    assert main(["--config", str(config), "migrations", "has-pending-changes"]) == 1
    capsys.readouterr()
    assert "_init" in run("migrations", "add", "init")
    assert run("migrations", "list").startswith("  20")
    assert "_init" in run("database", "update") and "nothing to do" in run("database", "update")
    assert run("migrations", "list").startswith("x 20")
    assert "CREATE TABLE" in run("script") and "up to date" in run("migrations", "repair")
    assert main(["--config", str(config), "migrations", "remove"]) == 1
    assert "_init" in run("database", "update", "--down", "1") and "_init" in run("migrations", "remove")
