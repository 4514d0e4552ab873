import duckdb

from granary.llm.quote_links import OP6_SQL, conversations_in_reply_order

A, B, C = "First thought here.\nSecond line of it.", "> First thought here.\n> Second line of it.\n\nI agree.", "On Monday, Ann wrote:\n> > first  THOUGHT here.\n> I agree.\n\nSo do I."
ROWS = [
    (1, 0, "user", A),
    (1, 1, "assistant", B),  # replies to 0 as a whole
    (1, 2, "user", C),  # its outermost quote is of 1
    (1, 3, "user", ">Second line of it.\nWhat of that?"),  # one line of 0, also quoted in 1
    (1, 4, "user", "> never said\nOdd."),  # links to nothing
    (1, 5, "user", "5 > 3 is no quote"),
    (2, 0, "user", "> First thought here.\nother conversation"),
    (3, 0, "user", None),
    (3, 1, None, ""),
    (3, 1, None, ""),
    (None, 1, "user", "> x"),
    (4, 0, "user", "I agree."),
    (4, 1, "user", "I agree."),
    (4, 2, "user", "> I agree.\nyes"),  # the latest of equals
    (5, 0, "user", "> later words\nq"),
    (5, 1, "user", "later words"),  # only earlier messages are originals
]


def test_links_threads_and_text(spark):
    frame = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, thread string")
    found = conversations_in_reply_order(frame).collect()
    assert len(found) == len(ROWS)
    by = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.text) for r in found}
    assert by[1, 0] == (None, 0, 0, A)
    assert by[1, 1] == (0, 0, 1, "I agree.")
    assert by[1, 2] == (1, 0, 2, "So do I.")
    assert by[1, 3] == (0, 0, 1, "What of that?")
    assert by[1, 4] == (None, 4, 0, "Odd.")
    assert by[1, 5] == (None, 5, 0, "5 > 3 is no quote")
    assert by[2, 0] == (None, 0, 0, "other conversation")
    assert by[3, 0] == (None, 0, 0, "") and by[3, 1] == (None, 1, 0, "")
    assert by[None, 1] == (None, 1, 0, "")
    assert by[4, 2][:3] == (1, 1, 1) and by[5, 0][:3] == (None, 0, 0)


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "message 0")] + [(1, k, "user", f"> message {k - 1}\nmessage {k}") for k in range(1, 40)]
    found = conversations_in_reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.reply_to, r.thread, r.depth, r.text) for r in found if r.turn) == [(k, k - 1, 0, k, f"message {k}") for k in range(1, 40)]


def test_empty_table(spark):
    assert conversations_in_reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sql_says_the_same(spark):
    duck = duckdb.connect()
    duck.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    duck.executemany("insert into conversations values (?, ?, ?, ?)", [list(r) for r in ROWS])
    found = conversations_in_reply_order(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    theirs = duck.sql(f"select {', '.join(found.columns)} from ({OP6_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, theirs))
