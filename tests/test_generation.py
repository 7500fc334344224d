import ast
import random

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import scoring as sc
from glyphloom.operators import generation as gen
from glyphloom.sources import reports


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in sorted(df.select("i", fn(F.col("v")).alias("x")).collect(), key=lambda r: r.i)]


def collapse(ids):
    run = 1
    for i in range(1, len(ids)):
        run = run + 1 if ids[i] == ids[i - 1] else 1
        if run > 3:
            return i - 3
    return len(ids)


def test_tokens_before_collapse(spark):
    rng = random.Random(1)
    fixed = [[], [1, 2], [7, 7, 7, 7], [1, 2, 5, 5, 5, 5], [3, 7, 7, 7, 7, 9]]
    values = fixed + [[rng.randint(0, 1) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    got = column(spark, values, "array<int>", sc.tokens_before_collapse)
    assert got[:5] == [0, 2, 0, 2, 1]
    assert got == [collapse(v) for v in values]


def test_stop_rule(spark):
    rng = random.Random(2)

    def stop(ids, sep=3, cap=9):
        out = []
        for x in ids[:cap]:
            out.append(x)
            if x == sep or (len(out) >= 4 and len(set(out[-4:])) == 1):
                break
        return out

    values = [[rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(200)]
    got = column(spark, values, "array<int>", lambda c: sc.truncate_generation(c, F.lit(3), 9))
    assert got == [stop(v) for v in values]


def test_repetition_and_emptiness(spark):
    texts = ["one", "a b a b", "", "A b  a\tB", "x y z"]
    got = column(spark, texts, "string", sc.repetition_rate)
    assert got == pytest.approx([0.0, 1 / 3, 0.0, 1 / 3, 0.0])
    texts = ["", " \n", "\uE100\uE000 ▁", "\uF8FF", "x", "\u00A0", None]
    assert column(spark, texts, "string", sc.nonempty_content) == [False] * 4 + [True, False, False]


def test_prose_prompts(spark):
    texts = ["short", "w" * 61, "x" * 25 + " " + "y" * 60, "a " * 40, "x" * 20 + " " + "y" * 60, "b" * 60]

    def prompt(text):
        if len(text) <= 60:
            return None
        cut = text[:50].rfind(" ")
        return text[:cut] if cut > 20 else text[:50]

    assert column(spark, texts, "string", sc.prose_prompt) == [prompt(x) for x in texts]


def test_code_prompts(spark):
    codes = ["def f(x):\n    return x", "def f(x,\n  y):", "func (q *query) Close() {\n}", "x = 1", "  def g():",
             " def f(): \n\n"]
    assert column(spark, codes, "string", sc.code_prompt) == [
        "def f(x):", None, "func (q *query) Close() {", None, "  def g():", " def f(): "]
    assert column(spark, codes[:1] + codes[4:], "string", sc.code_target) == ["    return x", "", "\n"]


def balanced(code):
    pairs, stack, quote, skip = {")": "(", "]": "[", "}": "{"}, [], None, False
    for c in code:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = None if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in pairs.values():
            stack.append(c)
        elif c in pairs:
            if not stack or stack.pop() != pairs[c]:
                return False
    return quote is None and not stack


def test_brackets(spark):
    rng = random.Random(6)
    codes = ["", "()", "(]", "('(')", '"\\""', "\\", "(\\)", "`{`{}"] + [
        "".join(rng.choices("()[]{}\"'\\a\n", k=rng.randint(0, 10))) for _ in range(500)]
    assert column(spark, codes, "string", sc.brackets_balanced) == [balanced(c) for c in codes]


def test_go_source_closes_once(spark):
    df = spark.createDataFrame([("func f() {", "x()"), ("func f() {", "x()\n} ")], "p string, c string")
    rows = [r.s for r in df.select(sc.go_source(F.col("p"), F.col("c")).alias("s")).collect()]
    assert rows == ["package main\n\nfunc f() { x()\n}", "package main\n\nfunc f() { x()\n} "]


def generations(spark):
    rows = [
        ("r", 1, "p1", "", [], 1.0), ("r", 2, "p2", "a b c", ["a", "b", "c"], 3.0),
        ("r", 3, "p3", "x x x x x x", ["x"] * 6, 6.0), ("r", 4, "p4", "d", [str(i) for i in range(25)], 5.0)]
    return spark.createDataFrame(rows, "run string, prompt_id int, prompt string, completion string, "
                                       "tokens array<string>, gen_time double")


def test_summary_and_throughput(spark):
    df = gen.scored(generations(spark))
    row = gen.summary(df).first()
    assert (row.n, row.pct_empty, row.avg_tokens_generated) == (4, 25.0, 34 / 4)
    assert row.avg_tokens_before_collapse == 28 / 4
    assert row.success_rate == pytest.approx((1 - (1 + 0 + 0.8 + 0) / 4) * 100)
    speed = gen.coherent_throughput(df.withColumn("coherent_chars", F.lit(8))).first()
    assert speed.tokens_per_sec == pytest.approx(28 / 8) and speed.chars_per_sec == pytest.approx(32 / 8)
    idle = gen.coherent_throughput(df.withColumn("coherent_time", F.lit(0.0)).withColumn(
        "coherent_chars", F.lit(8))).first()
    assert idle.tokens_per_sec == 0


def test_samples(spark):
    df = gen.scored(generations(spark))
    rows = {r.success: r for r in gen.first_samples(df).collect()}
    assert rows[True].prompt_id == 2 and rows[False].prompt_id == 1
    only = gen.first_samples(df.filter("prompt_id = 4")).first()
    assert len(only.tokens) == 21 and only.tokens[-1] == "..."
    lines = [r.line for r in reports.sample_report(gen.first_samples(df.filter("prompt_id = 2")))
             .orderBy("ord").collect()]
    assert lines[0] == "#### Success Sample" and "`['a', 'b', 'c']`" in lines[2]
    assert lines[-1] == "*No failure sample found for this configuration.*"


def test_python_gate(spark):
    rows = [("r", "def f(x):", "    return x"), ("r", "def f(x):", "return x"), ("r", "def f(x):", " \n"),
            ("s", "x = (", "1)"), ("s", "x = ", "1\x00"), ("s", "x = ", "'" * 3)]
    df = spark.createDataFrame(rows, "run string, prompt string, completion string")
    got = {r.run: r.success_rate for r in gen.python_gate(df).collect()}

    def ok(prompt, completion):
        try:
            ast.parse(prompt + "\n" + completion)
            return bool(completion.strip())
        except (SyntaxError, ValueError):
            return False

    assert got == {run: pytest.approx(100 * sum(ok(p, c) for r, p, c in rows if r == run) / 3) for run in "rs"}


def test_bracket_gate(spark):
    rows = [("r", "func f() {", "x()\n}"), ("r", "func f() {", "x(]\n}"), ("r", "func f() {", "  ")]
    df = spark.createDataFrame(rows, "run string, prompt string, completion string")
    assert gen.bracket_gate(df).first().success_rate == pytest.approx(100 / 3)
