from scrubjay.llm import chat_format

SCHEMA = "pair_id long, side string, turn long, role string, text string, part string, said string"


def test_prefix_completions_and_masks(spark):
    rows = []

    def add(pair, side, *turns):
        rows.extend((pair, side, k, r, t, "x", "y") for k, (r, t) in enumerate(turns))

    add(1, "chosen", ("system", "s"), ("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end"))
    add(1, "rejected", ("system", "s"), ("user", "q"), ("assistant", "bad"))
    add(2, "chosen", ("user", "same"), ("assistant", None))
    add(2, "rejected", ("user", "same"), ("assistant", ""))
    add(3, "chosen", ("user", "only"))
    add(None, "chosen", ("user", "lost"))
    rows.append((2, "chosen", 0, "user", "same", "x", "y"))  # a turn twice
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.pair_id: r for r in chat_format.rendered(chat_format.segments(df)).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == say("system", "s") + say("user", "q")
    assert got[1].chosen == say("assistant", "good") + say("user", "more") + say("assistant", "end") and got[1].rejected == say("assistant", "bad")
    assert (got[1].chosen_learned, got[1].rejected_learned) == (len("good<|end|>\n") + len("end<|end|>\n"), len("bad<|end|>\n"))
    assert got[2].prompt == say("user", "same") + say("assistant", "") and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt == "" and got[3].chosen == say("user", "only") and got[3].rejected == "" and got[3].chosen_learned == 0
    masks = {(r.part, r.turn): r["mask"] for r in chat_format.segments(df).where("pair_id = 1").collect()}
    assert masks == {("prompt", 0): 0, ("prompt", 1): 0, ("chosen", 2): 1, ("chosen", 3): 0, ("chosen", 4): 1, ("rejected", 2): 1}
    assert chat_format.segments(df.limit(0)).count() == 0


def test_different_turns_of_one_number_all_stay(spark):
    rows = [(1, side, k, r, t, "x", "y") for side in ("chosen", "rejected") for k, r, t in ((0, "user", "b"), (0, "user", "a"), (0, "user", "a"), (1, "assistant", side))]
    rows.append((1, "rejected", 1, "assistant", "again", "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.part, r.turn, r.repeat, r.body) for r in chat_format.segments(df).collect()))
    end = "<|end|>\n"
    assert got == [("chosen", 1, 1, "chosen" + end), ("prompt", 0, 1, "a" + end), ("prompt", 0, 2, "b" + end), ("rejected", 1, 1, "again" + end), ("rejected", 1, 2, "rejected" + end)]
    assert chat_format.rendered(chat_format.segments(df)).first().prompt == f"<|user|>\na{end}<|user|>\nb{end}"
