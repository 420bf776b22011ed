import datetime as dt

import pytest

from tessella.operators import review

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture
def state(spark, tmp_path):
    """Paper 1 with two people in slot A and one in slot B, both official; paper 2 with one person in each; paper 3 with one slot."""
    slots = [(1, "A", True), (1, "B", True), (1, "C", False), (2, "A", True), (2, "B", True), (3, "A", True)]
    people = [(11, 1, "A", 101, "primary"), (12, 1, "A", 102, "second"), (13, 1, "B", 103, "primary"), (21, 2, "A", 101, "primary"), (22, 2, "B", 103, "primary"), (31, 3, "A", 101, "primary")]
    frame = lambda name, rows: spark.createDataFrame(rows, review.SCHEMAS[name])
    return review.State(
        frame("slots", [(*s, "pending", None, None, None) for s in slots]),
        frame("assignments", [(i, p, s, r, role, r + 1000, "assigned", None, at(0), None, None, None, 1) for i, p, s, r, role in people]),
        frame("submissions", []), frame("conflicts", []), frame("outcomes", []),
    )


class Run:
    """Applies steps, writing each state, as a user would."""

    def __init__(self, spark, path, state):
        self.spark, self.path, self.state, self.n = spark, path, state, 0

    def __call__(self, step, rows, schema):
        new, refused = step(self.state, self.spark.createDataFrame(rows, schema))
        self.n += 1
        out = {}
        for name in review.SCHEMAS:
            df = getattr(new, name)
            df.write.parquet(f"{self.path}/{self.n}/{name}")
            out[name] = self.spark.read.schema(review.SCHEMAS[name]).parquet(f"{self.path}/{self.n}/{name}")
        why = {r["request"]: r["reason"] for r in refused.collect()}
        self.before, self.state = self.state, review.State(**out)
        return why

    def submit(self, *rows):
        return self(review.submit, [(*r, 1, 1, at(10 + self.n), True) for r in rows], "request long, assignment long, user long, decision string, hash string, foods int, nutrients int, at timestamp, may_write boolean")

    def slots(self, paper):
        return {r["slot"]: (r["status"], r["official_id"]) for r in self.state.slots.filter(f"paper = {paper}").collect()}

    def assignments(self, paper):
        return {r["id"]: r["status"] for r in self.state.assignments.filter(f"paper = {paper}").collect()}

    def conflicts(self, paper):
        return {(r["kind"], r["slot"]): (r["status"], r["left"], r["right"], r["chosen"]) for r in self.state.conflicts.filter(f"paper = {paper}").collect()}

    def outcome(self, paper):
        return [(r["source"], r["hash"], r["chosen"], r["by"]) for r in self.state.outcomes.filter(f"paper = {paper}").collect()]


def test_saving_work(spark, tmp_path, state):
    run = Run(spark, str(tmp_path), state)
    schema = "request long, assignment long, user long, status string, at timestamp, may_write boolean, expected int"
    why = run(review.touch, [(1, 11, 1101, "draft", at(1), True, 1), (2, 11, 1101, "draft", at(2), True, None), (3, 12, 1101, "draft", at(1), True, None), (4, 13, 1103, "open", at(1), True, None), (5, 21, 1101, "draft", at(1), False, None), (6, 99, 1101, "draft", at(1), True, None), (7, 22, 1103, "draft", at(1), True, 5)], schema)
    assert why == {2: "changed_meanwhile", 3: "not_yours", 4: "unknown_status", 5: "read_only", 6: "not_yours", 7: "changed_meanwhile"}
    assert run.assignments(1) == {11: "draft", 12: "assigned", 13: "assigned"}
    assert run.state.assignments.filter("id = 11").first()["version"] == 2


def test_agreement_makes_an_outcome(spark, tmp_path, state):
    run = Run(spark, str(tmp_path), state)
    assert run.submit((501, 11, 1101, "has_data", "x")) == {}
    assert run.slots(1)["A"] == ("pending", None) and run.assignments(1)[11] == "submitted"
    assert run.submit((502, 12, 1102, "has_data", "x")) == {}
    assert run.slots(1)["A"] == ("submitted", 501) and run.outcome(1) == []  # the primary member's
    assert run.submit((503, 13, 1103, "has_data", "x")) == {}
    assert run.slots(1) == {"A": ("resolved", 501), "B": ("resolved", 503), "C": ("pending", None)}
    assert run.assignments(1) == {11: "resolved", 12: "resolved", 13: "resolved"} and run.outcome(1) == [("slot_agreement", "x", 501, None)]
    assert run.submit((504, 13, 1103, "has_data", "y")) == {504: "closed"}
    feed = {(r["table"], r["key"]): (r["was"], r["is"]) for r in review.changes(state, run.state).collect()}
    assert feed["slots", "1:A"] == ("pending", "resolved") and feed["outcomes", "1"] == (None, "slot_agreement") and ("slots", "2:A") not in feed


def test_conflicts_inside_a_slot_and_between_slots(spark, tmp_path, state):
    run = Run(spark, str(tmp_path), state)
    run.submit((501, 11, 1101, "has_data", "x"), (502, 12, 1102, "has_data", "y"), (503, 13, 1103, "has_data", "z"))
    assert run.slots(1)["A"] == ("conflict", None) and run.slots(1)["B"] == ("submitted", 503)
    assert run.assignments(1) == {11: "conflict", 12: "conflict", 13: "submitted"}
    assert run.conflicts(1) == {(review.INTERNAL, "A"): ("open", 501, 502, None)}
    # one hands in another review, which still differs: the open conflict is brought up to date
    run.submit((504, 12, 1102, "has_data", "w"))
    assert run.conflicts(1) == {(review.INTERNAL, "A"): ("open", 501, 504, None)}
    schema = "request long, conflict string, chosen long, user long, at timestamp, may_write boolean"
    (inner,) = [r["id"] for r in run.state.conflicts.collect()]
    assert run(review.resolve, [(1, inner, 502, 9, at(30), True), (2, inner, 501, 9, at(30), False), (3, "none", 501, 9, at(30), True)], schema) == {1: "not_a_side", 2: "read_only", 3: "not_open"}
    assert run(review.resolve, [(1, inner, 504, 9, at(31), True), (2, inner, 501, 9, at(32), True)], schema) == {2: "changed_meanwhile"}
    # the slot has its decision, and now the two slots differ
    assert run.slots(1)["A"] == ("conflict", 504) and run.slots(1)["B"] == ("conflict", 503)
    assert run.conflicts(1)[review.EXTERNAL, None] == ("open", 504, 503, None) and run.outcome(1) == []
    outer = run.state.conflicts.filter(f"kind = '{review.EXTERNAL}'").first()["id"]
    assert run(review.resolve, [(1, outer, 503, 9, at(33), True)], schema) == {}
    assert run.outcome(1) == [("conflict_resolution", "z", 503, 1103)] and set(run.assignments(1).values()) == {"resolved"}
    assert {k: v[0] for k, v in run.conflicts(1).items()} == {(review.INTERNAL, "A"): "resolved", (review.EXTERNAL, None): "resolved"}


def test_an_outer_conflict_ends_when_the_slots_agree(spark, tmp_path, state):
    run = Run(spark, str(tmp_path), state)
    run.submit((601, 21, 1101, "has_data", "x"), (602, 22, 1103, "no_usable_data", "none"))
    assert run.slots(2) == {"A": ("conflict", 601), "B": ("conflict", 602)} and run.conflicts(2)[review.EXTERNAL, None][0] == "open"
    run.submit((603, 22, 1103, "has_data", "x"))
    assert run.outcome(2) == [("slot_agreement", "x", 601, None)] and run.conflicts(2)[review.EXTERNAL, None][0] == "resolved"


def test_reviews_that_are_refused(spark, tmp_path, state):
    run = Run(spark, str(tmp_path), state)
    schema = "request long, assignment long, user long, decision string, hash string, foods int, nutrients int, at timestamp, may_write boolean"
    rows = [(1, 11, 1101, "maybe", "x", 1, 1, at(1), True), (2, 11, 1101, "has_data", "x", 1, 0, at(1), True), (3, 12, 1102, "has_data", "x", None, 1, at(1), True), (4, 13, 1103, "no_usable_data", "n", 0, 0, at(1), True), (5, 21, None, "has_data", "x", 1, 1, at(1), True)]
    assert run(review.submit, rows, schema) == {1: "unknown_decision", 2: "no_rows", 3: "no_rows", 5: "not_yours"}
    assert run.slots(1)["B"] == ("submitted", 4)


def test_papers_without_data_are_closed(spark, tmp_path, state):
    run = Run(spark, str(tmp_path), state)
    run.submit((501, 11, 1101, "has_data", "x"), (502, 12, 1102, "has_data", "y"), (601, 21, 1101, "has_data", "x"), (602, 22, 1103, "has_data", "x"))
    schema = "request long, assignment long, user long, note string, at timestamp, may_write boolean"
    why = run(review.close_without_data, [(1, 13, 1103, "a letter", at(20), True), (2, 11, 1101, "me too", at(21), True), (3, 21, 1101, "late", at(20), True), (4, 31, 1101, " ", at(20), True)], schema)
    assert why == {2: "changed_meanwhile", 3: "closed", 4: "no_reason"}
    assert run.slots(1) == {k: ("cancelled", None) for k in "ABC"} and set(run.assignments(1).values()) == {"cancelled"} and run.conflicts(1)[review.INTERNAL, "A"][0] == "cancelled"
    assert [(s, c, by) for s, _, c, by in run.outcome(1)] == [("global_skip", None, 1103)]
    assert run.submit((700, 12, 1102, "has_data", "y")) == {700: "closed"} and run.slots(1)["A"] == ("cancelled", None)
