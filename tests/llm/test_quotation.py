from kgloom.llm.quotation import chat_quotes, link_quotes

ROWS = [
    (1, 0, "user", "How do I sort a table?\nI tried everything."),
    (1, 1, "assistant", "Use an ordered query."),
    (1, 2, "user", "> Use an ordered QUERY.\nWhich  column?"),
    (1, 3, "assistant", "> > Use an ordered query.\n> Which column?\nThe first one.\n"),
    (1, 4, "user", "> How do I sort a table?\n> I tried everything.\nNever mind."),
    (1, 5, "user", "> nobody ever said this\nok then, fine"),
    (2, 0, "user", "Use an ordered query."),
    (2, 1, "assistant", "> Use an ordered query.\n> short\nyes"),
    (2, 2, "user", "> > > > deep deep deep\nUse an ordered query."),
    (2, 3, "user", "> Use an ordered query.\nagain"),
    (3, 0, None, None),
    (3, 0, None, None),
    (None, 1, "user", "text of no conversation"),
    (None, 2, "user", "> text of no conversation\nright"),
    (4, None, "user", "> text of no conversation"),
    (5, 0, "user", "long line " * 20000),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "conv_id long, turn long, role string, text string, thread int, part string")
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert len(got) == 15 and got[3, 0].copies == 2
    assert (got[1, 2].reply_to, got[1, 2].thread, got[1, 2].body, got[1, 2].place) == (1, 1, "Which  column?", 2)
    assert (got[1, 3].reply_to, got[1, 3].quotes, got[1, 3].linked, got[1, 3].deepest, got[1, 3].thread) == (2, 2, 2, 2, 1)
    assert (got[1, 4].reply_to, got[1, 4].thread, got[1, 4].body) == (0, 0, "Never mind.")
    assert (got[1, 5].reply_to, got[1, 5].quotes, got[1, 5].linked, got[1, 5].thread) == (None, 1, 0, 5)
    assert got[2, 1].reply_to is None and got[2, 1].quotes == 1
    assert (got[2, 2].deepest, got[2, 2].reply_to) == (4, None)
    assert got[2, 3].reply_to == 2
    assert got[None, 2].reply_to == 1 and got[4, None].reply_to is None and got[4, None].body == "> text of no conversation"
    assert got[1, 1].formatted == "<|assistant|>\nUse an ordered query.\n" and got[3, 0].formatted == "<|unknown|>\n\n"
    assert link_quotes(df.limit(0)).count() == 0


def test_partial_and_short_quotes(spark):
    """Some lines of a longer passage, lines around a blank one, quotes of few characters; no run across two messages."""
    rows = [
        (1, 0, "first of four\nsecond of four\n\nthird of four\nfourth of four"),
        (1, 1, "Yes"),
        (1, 2, "> First of  four\n> second of four\nagreed"),
        (1, 3, "> second of four\n>\n> third of four\nand this?"),
        (1, 4, "> yes\nfine"),
        (1, 5, "> first of four\n> third of four\nnot a run"),
        (1, 6, "> fourth of four\n> Yes\nof two messages"),
        (1, 7, "> \nnothing quoted"),
        (1, 8, "third of four\nfourth of four\nsaid again"),
        (1, 9, "> third of four\n> fourth of four\nthe latest"),
        (None, 0, "a\nb\nc"),
        (None, 1, "> b\n> c\nok"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.linked) for r in link_quotes(df).collect()}
    assert [got[1, t] for t in range(2, 10)] == [(0, 1), (0, 1), (1, 1), (None, 0), (None, 0), (None, 0), (None, 0), (8, 1)]
    assert got[None, 1] == (0, 1)


def test_rewrapped_quotes_and_quotes_that_stay(spark):
    """Quotes wrapped anew, of the middle of a line, nested and rewrapped; code and prompts that nobody said stay in the body."""
    rows = [
        (1, 0, "The house is large and the garden is small,\nso we play in the house when it rains."),
        (1, 1, "> the garden is small, so we play\n> in the house\nGood."),
        (1, 2, "> > is large and the\n> > garden is small,\n> Good.\nIndeed."),
        (1, 3, ">>> print('hello')\nthe output is\n$ echo > file"),
        (1, 4, "> the house is small and the garden is large\nNo, the other way."),
        (1, 5, "> is large\ntoo short to be looked for inside a line"),
        (1, 6, "intro\n> Indeed.\n> > nobody said this at all\noutro"),
        (2, 0, "The house is large and the garden is small,"),
        (2, 1, "> The\n> house\n> is\n> large\n> and\none word a line " + "word " * 30000),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, t].reply_to, got[1, t].linked) for t in range(7)] == [(None, 0), (0, 1), (1, 2), (None, 0), (None, 0), (None, 0), (2, 1)]
    assert got[1, 1].body == "Good." and got[1, 2].body == "Indeed."
    assert got[1, 3].body == ">>> print('hello')\nthe output is\n$ echo > file"
    assert got[1, 4].body == "> the house is small and the garden is large\nNo, the other way."
    assert got[1, 6].body == "intro\n> > nobody said this at all\noutro"
    assert got[2, 1].reply_to == 0 and got[2, 1].body.startswith("one word a line")


def test_derived_quotes(spark):
    out = chat_quotes(spark, "/root/testdata/sf0.001")
    n, quotes, linked = out.selectExpr("count(*)", "sum(quotes)", "sum(linked)").first()
    assert n == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count() and quotes == linked > 0


def test_against_brute_force(spark):
    import random
    import re

    random.seed(4)
    rows = []
    for c in range(40):
        said = []
        for t in range(random.randint(1, 9)):
            own = random.choice(["first common remark", "another common remark", f"remark number {t} of {c}"])
            quoted = random.choice(said) if said and random.random() < 0.6 else None
            rows.append((c, t, "user", (f"> {quoted}\n" if quoted else "") + own))
            said.append(own)
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, t, _, text in rows:
        m = re.match(r"> (.*)\n", text)
        want = max((u for d, u, _, x in rows if d == c and u < t and m and x.split("\n")[-1] == m[1]), default=None)
        assert got[c, t].reply_to == want
        at = t
        while got[c, at].reply_to is not None:
            at = got[c, at].reply_to
        assert got[c, t].thread == at
