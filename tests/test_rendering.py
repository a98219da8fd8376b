from hashlib import sha256

from pyspark.sql import functions as F

from gradus.functions import rendering, text


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(*columns).first()


def test_options_in_fixed_order(spark):
    o = {"D": "d", "B": "b", "A": "a", "C": None, "E": "gone"}
    assert one(spark, rendering.format_options(F.col("o")), o=("map<string,string>", o))[0] == "A. a\nB. b\nC. None\nD. d"
    assert one(spark, rendering.format_options(F.col("o")), o=("map<string,string>", {"B": "b"}))[0] == "B. b"


def test_values_are_never_rescanned(spark):
    stem = "quoted {options} and {stem} $1 \\2"
    got = one(spark, rendering.render_prompt('{"json": {x}} {stem}|{options}', F.col("s"), F.col("o")), s=("string", stem), o=("map<string,string>", {"A": "{stem}"}))[0]
    assert got == '{"json": {x}} ' + stem + "|A. {stem}"


def test_hash(spark):
    want = sha256("é\nb".encode()).hexdigest()[:12]
    assert [one(spark, rendering.prompt_hash(F.col("t")), t=("string", t))[0] for t in ("é\nb", "é\r\nb")] == [want, want]


def test_mock_answers_vary_by_key_and_repeat(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("i"))
    make = lambda m: [r[0] for r in df.select(rendering.mock_answer(F.col("i"), F.lit(m), F.lit("plain"))).collect()]
    assert make("x") == make("x") != make("y") and set(make("x")) == set("ABCD")


def test_text_measures(spark):
    df = spark.createDataFrame([("The cat sat.", "1.5 mg of 20", "mg of 20"), ("", None, None), (None, "3", "3")], "t string, a string, b string")
    rows = df.select(text.fk_grade(F.col("t")), text.lost_numbers(F.col("a"), F.col("b"))).collect()
    assert abs(rows[0][0] - (0.39 * 3 + 11.8 - 15.59)) < 1e-9 and rows[1][0] is None and rows[2][0] is None
    assert [r[1] for r in rows] == [["1.5"], [], []]
    raw = spark.createDataFrame([('{"level_b": "x", "level_c": "y"}',), ("nonsense",)], "r string").select(text.rewrite_levels(F.col("r")).alias("r")).select("r.*").collect()
    assert tuple(raw[0]) == ("x", "y") and tuple(raw[1]) == (None, None)
