import duckdb
import pandas as pd

from riskledger.llm import quotes, registry, sql

TALK = [
    (1, 0, "user", "Hello there, this is the first message.\n\nIt has two paragraphs, the second\nis wrapped."),
    (1, 1, "assistant", "Something new entirely."),
    (1, 2, "user", "On Monday Bob wrote:\n> Something new entirely.\nI agree with that."),
    (1, 3, "assistant", "> > Something new, ENTIRELY\n> I agree with that.\n\nMe too!"),
    (1, 4, "user", "> It has two paragraphs, the second is\n> wrapped\nYes it has."),
    (1, 5, "user", "> never said\nWhat?"),
    (1, 6, "user", ">> Me too!\n>>\n>> Yes it has.\n\nBoth."),
    (1, 7, "user", "Something new entirely."),
    (1, 8, "user", "> Something new entirely.\r\nAgain."),
    (2, 0, "user", "> Something new entirely.\nOther talk."),
    (2, 1, "user", "a > b\n  > Other talk.\nx"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, None, "user", "> y"),
    (3, None, None, "y"),
    (None, 0, "user", "x"),
    (None, 1, "user", "> x"),
    (4, 0, "user", "twice"),
    (4, 0, "user", "twice"),
    (4, 1, "user", "> twice"),
]


def talk(spark, rows=TALK):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn int, role string, text string, root string, position int")


def test_threads(spark):
    rows = quotes.conversations(talk(spark)).collect()
    assert len(rows) == len(TALK)
    one = {r.turn: r for r in rows if r.conv == 1}
    assert {t: r.parent for t, r in one.items()} == {0: None, 1: None, 2: 1, 3: 2, 4: 0, 5: None, 6: 4, 7: None, 8: 7}
    assert {t: (r.root, r.depth) for t, r in one.items()} == {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (0, 1), 5: (5, 0), 6: (0, 2), 7: (7, 0), 8: (7, 1)}
    assert [r.turn for r in sorted(one.values(), key=lambda r: r.position)] == [0, 4, 6, 1, 2, 3, 5, 7, 8]
    assert {t: r.text for t, r in one.items() if t in (2, 3, 5, 8)} == {2: "I agree with that.", 3: "Me too!", 5: "What?", 8: "Again."}
    assert [(one[t].quoted, one[t].found) for t in (2, 3, 4, 5, 6)] == [(1, 1), (2, 2), (1, 1), (1, 0), (2, 2)]
    two = {r.turn: r for r in rows if r.conv == 2}
    assert two[0].parent is None and two[1].parent == 0 and two[1].text == "a > b\nx"


def test_edge_rows(spark):
    rows = quotes.conversations(talk(spark)).collect()
    for conv in {r[0] for r in TALK}:
        own = sorted((r for r in rows if r.conv == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(sum(t[0] == conv for t in TALK)))
    assert all(r.parent is None for r in rows if r.conv is None or r.turn is None)
    assert [r.parent for r in rows if r.conv == 4] == [0 if r.turn else None for r in rows if r.conv == 4]
    assert quotes.conversations(talk(spark).where("false")).count() == 0


def test_long_chains_and_repeated_passages(spark, monkeypatch):
    """A hot conversation: each message quotes the one before and all say the same line."""
    monkeypatch.setattr(quotes, "CELL", 4)
    rows = [(1, 0, "u", "ok\nstep 0")] + [(1, i, "u", f"> ok\n> step {i - 1}\nok\nstep {i}") for i in range(1, 60)] + [(1, 60, "u", "> ok\nlast")]
    got = {r.turn: r for r in quotes.conversations(talk(spark, rows)).collect()}
    assert all(got[i].parent == i - 1 and got[i].depth == i and got[i].root == 0 for i in range(1, 61))
    assert [got[i].position for i in range(61)] == list(range(61))


def test_query_keeps_every_message(spark, sf):
    talk_ = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = registry.QUERIES["op6_quotes"](spark, sf).collect()
    assert sorted((r.conv_id, r.turn, r.role) for r in got) == sorted((r.conv_id, r.turn, r.role) for r in talk_)
    own = {(r.conv_id, r.turn): r.text for r in talk_}
    assert all(r.text == own[r.conv_id, r.turn].strip() for r in got if not any(x.startswith(">") for x in own[r.conv_id, r.turn].split("\n")))


def test_chat_lines(spark):
    out = quotes.chat_lines(quotes.conversations(talk(spark)).where("conv = 1")).orderBy("position").collect()
    assert out[1].line == '{"role":"user","content":"Yes it has."}' and len(out) == 9


def test_sql_says_the_same(spark):
    more = [(5, 0, "u", "One thing.\nAnother thing."), (5, 1, "u", "> One thing.\nNo.\n> Another thing.\nYes."), (5, 2, "u", "> No.\n\nWhy?\n>> One thing."), (5, 3, "u", "> > Yes.\n> > No.\n> Why?\nAnn said:\n> One thing.\nok")]
    rows = [t for t in TALK if t[:2] != (4, 0) and t[1] is not None] + more
    con = duckdb.connect()
    con.register("given", pd.DataFrame([("" if c is None else str(c), t, r, x) for c, t, r, x in rows], columns=["c", "turn", "role", "text"]))
    con.execute("CREATE VIEW conversations AS SELECT CASE WHEN c <> '' THEN c::BIGINT END AS conv_id, turn, role, text FROM given")
    names = ["conv_id", "turn", "role", "text", "parent", "root", "depth", "quoted", "found", "position"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql.QUOTES})").fetchall(), key=str)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = quotes.conversations(frame).withColumnRenamed("conv", "conv_id").select(*names).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert {r.turn: r.parent for r in got if r.conv_id == 5} == {0: None, 1: 0, 2: 1, 3: 0}
