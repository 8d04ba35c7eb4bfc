import random
import re

from pyspark.sql import functions as F

from marklake.functions import text as TX
from marklake.operators import segment as S

LINES = "script_id bigint, page_number bigint, line_idx bigint, text string, confidence double, struck_through boolean"


def scripts(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        at = 0
        for page in range(rng.randint(1, 4)):
            for _ in range(rng.randint(0, 6)):
                text = rng.choice(["plain words", "more text", "more text", "Part B", "Section C", f"{rng.randint(1, 9)}.", f"Q{rng.randint(1, 9)}) because", f"{rng.randint(1, 9)}. c) x"])
                rows.append((s, page, at, text, rng.choice([None, 0.5, 0.75]), False))
                at += 1
    return rows


def walk(rows):
    """Regions of one script, line by line."""
    regions, now = [], None
    for _, page, at, text, conf, _ in rows:
        section = re.fullmatch(r"(?:Part|Section) [A-Z]", text)
        number = re.match(r"Q?(\d)[.)]", text)
        if section:
            now = None
        elif number or now is None:
            now = {"q": number.group(1) if number else "UNMAPPED", "pages": {page}, "lines": [at], "conf": [conf]}
            regions.append(now)
        else:
            now["pages"].add(page)
            now["lines"].append(at)
            now["conf"].append(conf)
    seen, top, down = set(), None, []
    for r in regions:
        r["st"] = "UNMAPPED_REGION" if r["q"] == "UNMAPPED" else "AMBIGUOUS_MAPPING" if r["q"] in seen else "SPANS_PAGES" if len(r["pages"]) > 1 else "OK"
        seen.add(r["q"])
        low = r["q"] != "UNMAPPED" and top is not None and int(r["q"]) < top
        down.append(low)
        if r["q"] != "UNMAPPED" and not low:
            top = int(r["q"])
    for i, r in enumerate(regions):
        if r["st"] == "OK" and (down[i] or (i + 1 < len(regions) and down[i + 1])):
            r["st"] = "OUT_OF_ORDER"
    return [(r["q"], r["st"], len(r["lines"]), min((c for c in r["conf"] if c is not None), default=None)) for r in regions]


def test_segmentation_equals_walk(spark):
    rows = scripts(21)
    got = S.segment_scripts(spark.createDataFrame(rows, LINES), with_text=False).orderBy("script_id", "region_no").collect()
    for s in {r[0] for r in rows}:
        mine = [(r.question_number, r.status, r.n_lines, r.confidence) for r in got if r.script_id == s]
        assert mine == walk([r for r in rows if r[0] == s])


def test_headers(spark):
    cases = {"13.": "13", "1. c) thing": "1", "Q1.": "1", "Q13": "13", "Q.15": "15", "Part B 13.": "13", "Part B": None, "plain 13.": None, "1234.": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", TX.question_header(F.col("t")).alias("q"), TX.is_section_header(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.q == cases[r.t], r.t
        assert r.s == (r.t == "Part B")


def test_rejoin():
    assert S.rejoin(["very import-", "ant thing"]) == "very important thing"
    assert S.rejoin(["import", "ant"]) == "important"
    assert S.rejoin(["the", "cat"]) == "the cat"  # a complete common word
    assert S.rejoin(["a CNN", "net"]) == "a CNN net"  # capitals are complete
    assert S.rejoin(["strong", "structure"]) == "strong structure"  # long continuation
    assert S.rejoin(["", "  ", "x"]) == "x" and S.rejoin([]) == ""
    assert S.rejoin(["end.", "ant"]) == "end. ant"


def test_missing_questions(spark):
    rows = [(1, 0, 0, "1. a", None, False), (1, 0, 1, "3. b", None, False)]
    lines = spark.createDataFrame(rows, LINES)
    regions = S.segment_scripts(lines)
    out = S.with_missing(regions, lines.select("script_id").distinct(), ["1", "2", "3"])
    assert {(r.question_number, r.status) for r in out.collect()} == {("1", "OK"), ("3", "OK"), ("2", "MISSING_QUESTION_NUMBER")}


def labels(texts):
    now, out = "header", {}
    for t in texts:
        main, sub, roman = re.match(r"(?:Q|Question) ?(\d+)|(\d+)[.)]", t), re.match(r"\(([a-zA-Z])\)", t), re.match(r"\(([ivxIVX]+)\)", t)
        if main:
            now = "question_" + (main.group(1) or main.group(2))
        elif sub or roman:
            value = (sub or roman).group(1).lower()
            base = re.sub(r"_[a-zA-Z]$", "", now) if sub else now
            base = re.sub(r"_[ivxIVX]+$", "", base)
            now = f"{base}_{value}" if "question_" in now else f"question_{value}"
        out.setdefault(now, []).append(t)
    out.pop("header", None)
    if not out:
        whole = " ".join(t for t in texts if t)
        return {"question_1": whole} if whole else {}
    return {k: " ".join(v) for k, v in out.items()}


def test_nested_labels_equal_walk(spark):
    rng = random.Random(4)
    rows = []
    for s in range(60):
        at = 0
        for page in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 5)):
                pool = ["text", "text"] if s % 10 == 0 else ["text", "1. one", "Q2 two", "(a) sub", "(b) sub", "(i) rom", "(ii) rom", "(iv) rom", "3) three"]
                rows.append((s, page, at, rng.choice(pool), None, False))
                at += 1
    got = S.label_answers(spark.createDataFrame(rows, LINES)).collect()
    for s in range(60):
        assert {r.question_id: r.answer_text for r in got if r.script_id == s} == labels([r[3] for r in rows if r[0] == s]), s


def test_sentence_spans(spark):
    texts = ["One. Two!  Three?\n\nFour", "", "no end", "a.b. c", "  lead. x  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TX.sentence_spans(F.col("t")).alias("s")).collect()
    for r in rows:
        want, start = [], 0
        for m in [*re.finditer(r"[.!?]+\s+|\n+", r.t), None]:
            end = m.start() if m else len(r.t)
            if r.t[start:end].strip():
                want.append((start, end, r.t[start:end].strip()))
            start = m.end() if m else end
        assert [(x["start"], x["end"], x["piece"]) for x in r.s] == want


def test_paper_first_definition_wins(spark):
    text = ["Part - A - (5*2=10 Marks)", "Answer any five questions", "1. What is", "a stack?", "2) Next one", "Part - B - (3*4=12 Marks)", "lost line", "1. table entry", "tail"]
    lines = spark.createDataFrame([(1, i // 3, i, t) for i, t in enumerate(text)], "paper_id int, block int, line_idx int, text string")
    got = {r.question_number: r for r in S.paper_questions(lines).collect()}
    assert got["1"].question_text == "What is a stack? tail" and got["1"].part == "A" and got["1"].instruction == "Answer any five questions"
    assert got["2"].question_text == "Next one"
