from pyspark.sql import functions as F

from gradus.functions.answers import is_correct, parse_answer

LETTERS = "ABCD"
#: What finds a letter {x}, from the stage that is tried first to the last.
STAGES = {
    "whole": ["{x}", "\t{x}\n", "{x}..", " {l}. ", "{l}", "\x1d{x}\x1f", "{x} ..."],
    "word": ["final answer {x}", "ANSWER:{l}", "Answer - ({x})", "the answers: {x} here", "my answer\n{l}, surely"],
    "parentheses": ["choice ({x}) fits", "({x}), then", "see**({x})**"],
    "stars": ["choice **{x}** fits", "**{l}**!"],
    "alone": ["choice {x} fits", "{x}; no doubt", "it is {x}!", "{x}: yes", "fits \\{x}"],
}
NOTHING = [None, "", " \n\t ", "Z", "none of them fits", "a cab", "AB", "{x}_".format(x="A"), "ßA", "the answer is unknown", "(b)", "é", "answered: maybe"]


def cases():
    """Every pattern with every letter; two letters in one pattern; an earlier stage before a later one."""
    for i, x in enumerate(LETTERS):
        y = LETTERS[(i + 1) % 4]
        show = lambda p, z: p.format(x=z, l=z.lower())
        for patterns in STAGES.values():
            yield from ((show(p, x), x) for p in patterns)
        for name in ("word", "parentheses", "stars", "alone"):
            first = STAGES[name][0]
            yield f"{show(first, x)}; {show(first, y)}", None
            yield f"{show(first, x)}; {show(first, x)}", x
        for early, late in (("word", "parentheses"), ("word", "alone"), ("parentheses", "stars"), ("parentheses", "alone"), ("stars", "alone")):
            yield f"{show(STAGES[late][0], y)}; {show(STAGES[early][0], x)}", x
    yield from ((text, None) for text in NOTHING)


def parsed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return [r["p"] for r in df.select("i", parse_answer(F.col("raw"), **options).alias("p")).orderBy("i").collect()]


def test_grid(spark):
    want = list(cases())
    assert list(zip([w[0] for w in want], parsed(spark, [w[0] for w in want]))) == want and len(want) > 120


def test_other_letters_in_every_stage(spark):
    grid = [p.format(x="P", l="p") for patterns in STAGES.values() for p in patterns]
    assert parsed(spark, grid, valid_letters="PQ") == ["P"] * len(grid) and parsed(spark, grid) == [None] * len(grid)


def test_correct_has_three_states(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "A"), (None, "A")], "p string, g string")
    assert [r[0] for r in df.select(is_correct(F.col("p"), F.col("g"))).collect()] == [True, False, None]


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([("A",)], "raw string").select(parse_answer(F.col("raw")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
