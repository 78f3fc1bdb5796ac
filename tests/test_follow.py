"""Following a folder: the state of a path, and what of the files is read."""

import os

import pandas as pd
import pytest

from tarn.engine import Engine
from tarn.streaming.follow import follow, poll, step


class State:
    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_states():
    state = State()

    def see(*rows):
        out = list(step(("p",), iter([pd.DataFrame(rows, columns=["scan", "modified_us", "length"])]), state))
        return [tuple(x) for pdf in out for x in pdf[["path", "change"]].itertuples(index=False)]

    assert see((1, 10, 5)) == [("p", "added")]
    assert see((1, 10, 5)) == see((2, 10, 5)) == []  # again, and the same later
    assert see((3, 11, 5), (4, 12, 6)) == [("p", "changed")] and state.value == (4, 12, 6)
    assert see((2, 9, 9)) == []  # late
    assert see((5, 0, -1)) == [("p", "gone")] and see((6, 0, -1)) == [] and see((3, 9, 9)) == []
    assert see((7, 12, 6)) == [("p", "added")] and see((8, 0, -1), (9, 12, 6)) == []
    assert list(step(("p",), iter([]), state)) == []


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "docs"
    at.mkdir()
    for n in "abc":
        (at / f"{n}.md").write_text(f"# {n}\n\ntext of {n}\n")
        os.utime(at / f"{n}.md", (1_700_000_000, 1_700_000_000))
    return at


def bodies(e):
    docs, content = e.tables.read("documents").where("active"), e.tables.read("content")
    return {r.path: r.doc for r in docs.join(content, "hash").select("path", "doc").collect()}


def test_only_what_changed_is_read(spark, folder, tmp_path):
    e, place = Engine(spark, f"{tmp_path}/index"), f"{tmp_path}/follow"
    e.add_collection("m", str(folder))

    def run():
        q = follow(e, "m", place)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    assert set(bodies(e)) == {"a.md", "b.md", "c.md"}
    whole = Engine(spark, f"{tmp_path}/whole")
    whole.add_collection("m", str(folder))
    whole.update()
    assert bodies(whole) == bodies(e)
    # b is written in place with its length and moment kept: whoever reads it would see it
    (folder / "b.md").write_text("# b\n\nTEXT of b\n")
    os.utime(folder / "b.md", (1_700_000_000, 1_700_000_000))
    (folder / "a.md").write_text("# a\n\nanother text\n")
    (folder / "c.md").unlink()
    (folder / "d.md").write_text("# d\n\nfresh words\n")
    os.utime(folder / "d.md", (1_600_000_000, 1_600_000_000))  # moved here, older than all
    (folder / "e.md").write_text("  \n")
    run()
    assert bodies(e) == {"a.md": "# a\n\nanother text\n", "b.md": "# b\n\ntext of b\n", "d.md": "# d\n\nfresh words\n"}
    assert [r.path for r in e.search_lex("fresh words").collect()] == ["d.md"] and e.search_lex("c").where("path = 'c.md'").isEmpty()
    number = e.tables._current()[0]
    run()
    assert e.tables._current()[0] == number  # nothing to commit
    (folder / "a.md").unlink(), (folder / "b.md").unlink(), (folder / "d.md").write_text("\n")
    run()
    assert bodies(e) == {}


def test_a_look_cut_off_is_made_again(spark, folder, tmp_path):
    e, place = Engine(spark, f"{tmp_path}/index"), f"{tmp_path}/follow"
    e.add_collection("m", str(folder))
    assert poll(e, "m", place) == 1
    os.rename(f"{place}/listings/1", f"{place}/listings/1.tmp")
    assert poll(e, "m", place) == 1  # the same sightings twice
    q = follow(e, "m", place)
    q.awaitTermination(120)
    assert q.exception() is None and len(bodies(e)) == 3
