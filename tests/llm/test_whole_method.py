"""Examples with their contexts; siblings aligned exactly, however many."""

from stockroom.llm import chat
from stockroom.llm import html_extract as h


def test_every_example_holds_all_turns_before_it(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    rows = chat.prefix_target_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = rows.orderBy("example_no").collect()
    said = [f"### {r} ###\n{t}</turn>\n" for _, _, r, t in turns]
    assert [r["text"] for r in rows] == ["".join(said[:2]), "".join(said[:4]), "".join(said)]
    assert [r["text"][r["reply_start"]:r["reply_end"]] for r in rows[:2]] == ["b", "d"]
    assert [r["is_target"] for r in rows] == [True, True, False]


def _outline(labels):
    top = h.Outline("#root", None)
    for x in labels:
        h.Outline(x, top)
    return top


def test_many_siblings_are_aligned_exactly():
    a = _outline(["q"] + ["ul", "div"] * 130)
    b = _outline(["ul", "div"] * 20 + ["q"] + ["ul", "div"] * 110)
    shapes = {}
    h._shape(a, shapes)
    h._shape(b, shapes)
    pairs = h._pairs(a, b, {})
    assert len(pairs) == 260 and all(x.label == y.label for x, y in pairs)
    places = [(a.children.index(x), b.children.index(y)) for x, y in pairs]
    assert places == sorted(places)


def test_a_wide_row_gives_the_pairs_of_a_narrow_one(monkeypatch):
    a = _outline(["ul", "div", "q", "ul", "table"] * 30)
    b = _outline(["div", "ul", "table", "ul"] * 25)
    shapes = {}
    h._shape(a, shapes)
    h._shape(b, shapes)
    wide = h._pairs(a, b, {})
    monkeypatch.setattr(h, "WIDE", 10_000)
    assert h._pairs(a, b, {}) == wide
