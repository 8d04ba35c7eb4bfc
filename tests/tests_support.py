"""Small fixtures shared by tests."""

from marklake import schemas as SC

SCHEME = "question_id string, question_number string, question_text string, max_marks double, value_points array<" + SC.VALUE_POINT.simpleString() + ">"


def vp(id, text, marks=1.0, variants=(), mode="EXACT", group=None, rule=None, n=None, value=None, tol=None, unit=None):
    return (id, text, marks, list(variants), mode, group, rule, n, value, tol, unit)


# Our own small scheme: recall, any two of three, a worked equation, a description.
SCHEMES = [
    ("r", "1", "Which metal is liquid at room temperature?", 1.0, [vp("r1", "mercury", variants=["Hg"])]),
    (
        "g", "2", "Give two uses of copper.", 3.0,
        [
            vp("g1", "electric wires", 1.5, ["wiring"], group="u", rule="ANY_N", n=2),
            vp("g2", "water pipes", 1.5, group="u", rule="ANY_N", n=2),
            vp("g3", "coins", 1.5, group="u", rule="ANY_N", n=2),
        ],
    ),
    ("n", "3", "Solve 3y + 1 = 13.", 3.0, [vp("n1", "3y = 12", mode="STEP"), vp("n2", "y = 12/3", mode="STEP"), vp("n3", "y = 4", mode="NUMERIC", value=4.0, tol=0.01)]),
    ("d", "4", "How does a bird fly?", 4.0, [vp("d1", "wings"), vp("d2", "lift", variants=["upward push"]), vp("d3", "hollow bones"), vp("d4", "muscles")]),
]

QUESTIONS = [
    (1, "question_1", 0, "What makes copper useful? [4 marks]", "Copper conducts electricity well. Copper resists corrosion strongly."),
    (1, "question_2", 1, "Name the largest organ", "Human skin covers everything outside."),
]
