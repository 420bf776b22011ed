from tessella.llm import quotations

MESSAGES = [
    (1, 0, "a", "Yes. The meeting is at five."), (1, 1, "b", "> Yes.\nGood."),
    (2, 0, "a", "Hi Bob\n\nThe meeting is at five."), (2, 1, "b", "> The meeting is at five.\nFine."), (2, 2, "c", "> Hi Bob\nAnd Carol?"),
    (3, 0, "a", "To bring:\n- apples\n- plums\n- pears"), (3, 1, "b", "> - apples\n> - pears\nI have these."), (3, 2, "c", "> To bring: -\n> apples - plums - pears\nNo more?"),
    # a short sentence that someone says again does not draw the quote away
    (4, 0, "a", "Yes. The meeting is at five."), (4, 1, "b", "Yes."), (4, 2, "c", "> Yes. The meeting is at five.\nThanks."), (4, 3, "d", "> Yes.\nSure?"),
    # a sentence that begins on a line, or in a paragraph of two lines, of its own
    (5, 0, "a", "Dear all\nThe room is taken. Bring a pen.\n\nSee below\n\nThe next one is on\nMonday. Bye"), (5, 1, "b", "> The room is taken.\nOh."), (5, 2, "c", "> The next one is on Monday.\nSo late."),
    (6, 0, "a", "Nothing of the kind."), (6, 1, "b", "> Something else.\nWho said so?"), (6, 2, "b", "> ...\nWhat?"),
]


def test_short_and_unpunctuated_quotes_are_linked(spark):
    d = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["thread"], r["reply_to"], r["n_linked"]) for r in quotations.link_quotations(d).collect()}
    assert {k: v for k, v in got.items() if v[1] is not None} == {
        (1, 1): (0, 0, 1), (2, 1): (0, 0, 1), (2, 2): (0, 0, 1), (3, 1): (0, 0, 1), (3, 2): (0, 0, 1), (4, 2): (0, 0, 2), (4, 3): (1, 1, 1), (5, 1): (0, 0, 1), (5, 2): (0, 0, 1),
    }
    assert len(got) == len(MESSAGES)


def test_pieces_of_a_passage():
    whole = quotations.pieces("One two.\nThree\n\nfour five. Six")
    assert sorted(n for _, n, _ in whole) == [1, 1, 2, 2, 3, 3, 3, 6]
    assert max(whole, key=lambda x: x[1])[2] == [quotations._hash(x.split()) for x in ("one two", "three four five", "six")]
    assert quotations.pieces(" .\n- ") == []
