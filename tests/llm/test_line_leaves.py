import random

from corvane.llm import line_templates as lt


def test_indexed_templates_equal_the_plain_rule():
    rng = random.Random(4)
    for size in [3, 4, 5, 6, 9, 10, 15, 21]:
        lead = ["a", "b", "c"]
        lines = {tuple(lead + [rng.choice(["x", "y", "z", "<*>", "w%d" % rng.randrange(30)]) for _ in range(size - 3)]) for _ in range(700)}
        lines = [list(x) for x in sorted(lines, key=lambda x: hash(x))]
        for similar in (0.8, 0.5, 0.1, 1.0, 1.5):
            assert lt.indexed_templates(lines, similar) == lt.templates(lines, similar)
    assert lt.indexed_templates([]) == []


def test_lines_of_a_large_leaf_are_held_against_all_its_templates(spark):
    words = "the of and {} page printed for on this site".split()
    rng = random.Random(6)
    rows = [(i, "\n".join(["before " * (i + 1), " ".join(words).format("klmnopqrstuv"[i] + "zz"), "after " * (i + 1)])) for i in range(12)]
    # thousands of other lines of the same leaf, which lie between the twelve
    for i in range(3000):
        other = "the of and " + " ".join("".join(rng.choices("klmnopqrstuv", k=6)) for _ in range(7))
        rows.append((1000 + i, other))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.d: r.places for r in lt.repeated_lines(df).collect()}
    assert {i: 1 in got.get(i, []) for i in range(12)} == dict.fromkeys(range(12), True)


def test_boilerplate_of_several_lines_goes_whatever_surrounds_it(spark):
    footer = "first line of the footer\nsecond line of the footer\nthird line of the footer"
    rows = [(i, f"{'own ' * (i + 1)}words\n{footer}") for i in range(8)]
    rows += [(100 + i, "a copied document\nsecond line of the footer\nits own end") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_repeated_lines(df).collect()}
    assert all(got[i] == f"{'own ' * (i + 1)}words" for i in range(8))
    assert all(got[100 + i] == "a copied document\nits own end" for i in range(200))
